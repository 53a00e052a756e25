"""Seeds, splits and canonical JSON. Hashes of text are native; canonical JSON follows Python's number formatting and so is Python."""

from __future__ import annotations

import hashlib
import json
import math
import random
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domain tags keep the hashes of different uses apart. A study that has to agree with another passes that study's tags.
SEED_DOMAIN, SPLIT_DOMAIN, RANK_DOMAIN = "lumenfold-rng-v1", "lumenfold-split-v1", "lumenfold-rank-v1"


def tagged_sha256(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts as text, with NUL between them."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def derived_seed(master: Column, namespace: Column, bits: int = 63, domain: str = SEED_DOMAIN) -> Column:
    """The last `bits` (64 at most) of the tagged hash, as a decimal number."""
    if not 1 <= bits <= 64:
        raise ValueError("bits must be between 1 and 64")
    tail = F.conv(F.right(tagged_sha256(F.lit(domain), master, namespace), F.lit(16)), 16, 10).cast("decimal(20,0)")
    return F.pmod(tail, F.lit(2**bits).cast("decimal(20,0)")) if bits < 64 else tail


#: Bits of a seed, of the keys of a list, and the namespaces of keys: fixed values.
SEED_BITS, KEY_BITS = 63, 31
BENCHMARK_NAMESPACE, KEY_NAMESPACE = "benchmark-key/{}", "synthid/key/{}"


def derive_seed(master: int, namespace: str, bits: int = SEED_BITS, domain: str = SEED_DOMAIN) -> int:
    """derived_seed() on the driver, for any number of bits up to 256."""
    if master < 0 or not namespace:
        raise ValueError("the master seed must not be negative, nor the namespace empty")
    if not 1 <= bits <= 256:
        raise ValueError("bits must be between 1 and 256")
    return int.from_bytes(hashlib.sha256(f"{domain}\0{master}\0{namespace}".encode()).digest(), "big") & ((1 << bits) - 1)


def seeded_random(master: int, namespace: str, domain: str = SEED_DOMAIN) -> random.Random:
    return random.Random(derive_seed(master, namespace, SEED_BITS, domain))


def benchmark_key(master: int, mechanism: str, domain: str = SEED_DOMAIN) -> int:
    """A key that is not 0."""
    return derive_seed(master, BENCHMARK_NAMESPACE.format(mechanism), SEED_BITS, domain) or 1


def distinct_keys(master: int, count: int = 30, domain: str = SEED_DOMAIN) -> list[int]:
    """`count` distinct keys of KEY_BITS, in the order of their indices; a key met again is skipped."""
    if count <= 0:
        raise ValueError("count has to be positive")
    keys: dict[int, None] = {}
    index = 0
    while len(keys) < count:
        keys.setdefault(derive_seed(master, KEY_NAMESPACE.format(index), KEY_BITS, domain))
        index += 1
    return list(keys)


def third(sample_id: Column, seed: int, domain: str = SPLIT_DOMAIN) -> Column:
    """The first 64 bits of the tagged hash modulo 3: as 16 is 1 modulo 3, the sum of the first 16 hex digits is enough."""
    digits = F.split(F.left(tagged_sha256(F.lit(domain), F.lit(seed), sample_id), F.lit(16)), "")
    return (F.aggregate(digits, F.lit(0), lambda s, d: s + F.conv(d, 16, 10).cast("int")) % 3).cast("int")


def _finite(value: Any) -> Any:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("canonical JSON has finite numbers only")
    if isinstance(value, dict):
        return {str(k): _finite(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_finite(v) for v in value]
    return value


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, UTF-8 as it is, finite numbers only."""
    return json.dumps(_finite(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_sha256(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def typed_id(kind: str, value: Any) -> str:
    """kind, a hyphen and the first 24 digits of the canonical hash."""
    return f"{kind}-{canonical_sha256(value)[:24]}"


def _hash_of_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical_sha256(json.loads(t)))


def canonical_hash_of_json(text: Column) -> Column:
    """For a row a group. Made when called: workers import this module without a session."""
    return F.pandas_udf(_hash_of_json, "string")(text)


def no_duplicate_keys(text: str) -> Any:
    """Decodes JSON; a key met twice in one object is an error."""

    def pairs(found):
        keys = [k for k, _ in found]
        if len(keys) != len(set(keys)):
            raise ValueError("duplicate key")
        return dict(found)

    return json.loads(text, object_pairs_hook=pairs)
