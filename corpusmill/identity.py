"""Stable identities of records, rows and draws, as column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.udf import vectorised

#: The characters that str.split() takes as white space, for both engines' regular expressions.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """White-space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, WS, " "), "^ | $", "")


def gate_uid(source: Column, statement: Column) -> Column:
    return F.substring(F.sha2(F.concat(_text(source), F.lit("\x1f"), _text(statement)), 256), 1, 32)


def ingest_uid(source: Column, statement: Column) -> Column:
    return F.substring(F.sha1(F.concat(_text(source), F.lit("\x00"), _text(statement)).cast("binary")), 1, 12)


def dedup_key(statement: Column) -> Column:
    return collapse(F.lower(_text(statement)))


def stmt_key(statement: Column) -> Column:
    return F.sha2(dedup_key(statement), 256)


@vectorised("string")
def content_hash(line: pd.Series) -> pd.Series:
    """SHA-256 of a JSON line with its keys sorted; null where the line is not JSON."""

    def one(text):
        try:
            return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return line.map(one)


def python_bool(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def rollout_cache_key(model: Column, question: Column, temperature: Column, think: Column, sample_idx: Column) -> Column:
    """temperature: the number as text, in Python's form."""
    return F.substring(F.sha1(F.concat_ws("\x1f", _text(model), _text(question), temperature.cast("string"), python_bool(think), sample_idx.cast("string")).cast("binary")), 1, 16)


def statement_cache_key(statement: Column) -> Column:
    return F.substring(F.sha1(_text(statement).cast("binary")), 1, 16)


def judge_cache_key(provider: Column, model: Column, prompt: Column, sample_id: Column) -> Column:
    return F.sha2(F.concat(*[x for c in (provider, model, prompt, sample_id) for x in (_text(c), F.lit("\x1f"))]), 256)


def draw_rank(seed, *parts: Column) -> Column:
    """The order of a seeded draw: SHA-256 of seed and parts joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[_text(p) for p in parts]), 256)


def uid_set_digest(uid: Column) -> Column:
    """Aggregate: one digest for a set of distinct uids, whatever their order, in constant memory: their number and sums of two hashes."""
    one, two = F.xxhash64(uid), F.xxhash64(uid, F.lit("uid"))
    return F.sha2(F.concat_ws(":", F.count(uid).cast("string"), F.bit_xor(one).cast("string"), F.sum(two.cast("decimal(38,0)")).cast("string")), 256)
