"""Identifiers, ranges and orders that results have to agree on. They are stated as the Unicode and C2PA texts state them."""

from __future__ import annotations

#: Default_Ignorable_Code_Point, Unicode 17.0.0 (DerivedCoreProperties), inclusive ranges.
DEFAULT_IGNORABLE = (
    (0x00AD, 0x00AD),
    (0x034F, 0x034F),
    (0x061C, 0x061C),
    (0x115F, 0x1160),
    (0x17B4, 0x17B5),
    (0x180B, 0x180D),
    (0x180E, 0x180E),
    (0x180F, 0x180F),
    (0x200B, 0x200F),
    (0x202A, 0x202E),
    (0x2060, 0x2064),
    (0x2065, 0x2065),
    (0x2066, 0x206F),
    (0x3164, 0x3164),
    (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A),
    (0xE0000, 0xE0000),
    (0xE0001, 0xE0001),
    (0xE0002, 0xE001F),
    (0xE0020, 0xE007F),
    (0xE0080, 0xE00FF),
    (0xE0100, 0xE01EF),
    (0xE01F0, 0xE0FFF),
)
#: Bidi_Control, Unicode 17.0.0 (PropList), with the abbreviations of UAX #9.
BIDI_CONTROL = {
    0x061C: "ALM",
    0x200E: "LRM",
    0x200F: "RLM",
    0x202A: "LRE",
    0x202B: "RLE",
    0x202C: "PDF",
    0x202D: "LRO",
    0x202E: "RLO",
    0x2066: "LRI",
    0x2067: "RLI",
    0x2068: "FSI",
    0x2069: "PDI",
}

STATUSES = ("present", "absent", "unknown", "unsupported", "invalid", "not_applicable")
DICP = "unicode.default_ignorable_code_point"
BIDI = "unicode.bidi_control"
NFC = "unicode.normalization.nfc_difference"
NFKC = "unicode.normalization.nfkc_difference"
WRAPPER = "c2pa.text_manifest_wrapper"
STORE = "c2pa.manifest_store"
VALIDATION = "c2pa.manifest_validation"
BINDING = "c2pa.hard_binding"
TRUST = "c2pa.credential_trust"
REFERENCE_DETECTOR = "reference.synthid_text"
PROVIDER = "provider.embedded_text_watermark"
#: Canonical rank of mechanisms in a report; anything else comes after, by id.
MECHANISMS = (BIDI, DICP, NFC, NFKC, WRAPPER, STORE, VALIDATION, BINDING, TRUST, REFERENCE_DETECTOR, PROVIDER)
C2PA = (WRAPPER, STORE, VALIDATION, BINDING, TRUST)
#: Declaration order of inferences, which is their sort order.
INFERENCES = (
    "unicode_property_present", "unicode_property_absent_within_scope", "unicode_normalization_difference_present", "unicode_normalization_difference_absent_within_scope",
    "c2pa_carrier_present", "c2pa_carrier_absent_within_scope", "c2pa_manifest_store_present", "c2pa_manifest_store_absent_within_scope", "c2pa_claim_valid",
    "c2pa_hard_binding_valid", "c2pa_credential_trusted", "provider_mechanism_family_disclosed", "provider_detector_unavailable", "public_reference_watermark_present",
    "public_reference_watermark_absent_within_configuration", "artifact_clean", "human_authorship", "ai_authorship", "malicious_intent", "watermark_present",
    "watermark_absent", "c2pa_claim_validity", "c2pa_hard_binding", "c2pa_credential_trust", "authorship", "truthfulness", "claude_watermark_present",
    "claude_watermark_absent", "claude_provider_parity",
)
ALWAYS_FORBIDDEN = ("ai_authorship", "artifact_clean", "human_authorship")
INVALID_UTF8 = "failed: the complete artifact is malformed or incomplete UTF-8"
LOCATIONS, SCALARS, STATUS_CODES = 256, 8, 256

#: C2PA text wrapper (Appendix A.8): magic, version byte, four length bytes.
WRAPPER_MAGIC, WRAPPER_HEADER = b"C2PATXT\0", 13
PNG, JPEG = bytes.fromhex("89504E470D0A1A0A"), bytes.fromhex("FFD8FF")
#: Codes of hard-binding validation and their binding types.
BINDING_TYPES = {
    "assertion.dataHash.match": "data_hash",
    "assertion.dataHash.mismatch": "data_hash",
    "assertion.dataHash.malformed": "data_hash",
    "assertion.boxesHash.match": "boxes_hash",
    "assertion.boxesHash.mismatch": "boxes_hash",
    "assertion.boxesHash.malformed": "boxes_hash",
    "assertion.bmffHash.match": "bmff_hash",
    "assertion.bmffHash.mismatch": "bmff_hash",
    "assertion.bmffHash.malformed": "bmff_hash",
    "assertion.collectionHash.match": "collection_hash",
    "assertion.collectionHash.mismatch": "collection_hash",
}

#: Fields of a threshold's conditioning context, compared null-safely and exactly.
CONTEXT_FIELDS = (
    "scheme", "mechanism_version", "detector_config_sha256", "model_revision", "tokenizer_revision", "task", "key_policy", "threshold_semantics", "evidence_length_policy",
    "scored_unit_count", "regime", "operation", "operation_strength", "search_spec_sha256", "comparator", "comparator_authority",
)
#: Fields that records are grouped by.
GROUP_FIELDS = (
    "scheme", "mode", "task", "entropy_bucket", "nominal_generation_length", "evidence_length", "threshold_semantics", "threshold_id", "evaluation_kind", "transform",
    "transform_strength", "marked_fraction", "layout", "search_spec_id",
)

#: Literal patterns, in Java's dialect with Unicode classes.
URL = r"(?U)https?://[^\s)\]}>,]+"
NUMBER = r"(?U)(?<![\w.])[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w.])"
CODE = r"`{1,3}([^`]+)`{1,3}"
QUOTE = r"(?:\"([^\"]+)\"|'([^']+)')"
ANSWER = r"(?U)####\s*([+-]?[\d,]+(?:\.\d+)?)"
FALLBACK = r"(?U)[+-]?[\d,]+(?:\.\d+)?"
SENTENCE = r"(?U)(?<=[.!?])\s+"
