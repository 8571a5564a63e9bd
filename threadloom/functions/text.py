"""Text expressions: tokens, intents, hashed embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that tell an intent, tried in the order of the intents; blanks in a phrase count.
PHRASES = {
    "deepen": "break down|dive into|drill down|elaborate|expand on|explain more|go deeper|how does it work|in depth|more detail|tell me more|what exactly",
    "broaden": "big picture|broaden|context|high level|how does this fit|in general|overview|summarize|summary|wider",
    "compare": " versus |alternative|alternatives|compare|comparison|contrast|difference|different|other approach|similar|vs ",
    "apply": "application|apply|example|how to use|in practice|real world|use case|when to use|where is this used",
    "clarify": "clarify|confused|didn't understand|don't understand|simple explanation|simpler|unclear|what do you mean",
}


def tokens(text: Column) -> Column:
    """Tokens between Unicode white space; an empty array for none or null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def intent_of(text: Column) -> Column:
    """The first intent with a phrase in the lower-cased, blank-collapsed text; else neutral."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")), " +", " ")
    out = None
    for intent, phrases in PHRASES.items():
        hit = None
        for p in phrases.split("|"):
            c = F.contains(plain, F.lit(p))
            hit = c if hit is None else hit | c
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise("neutral")


def hashed_embedding(text: Column, dim: int = 16) -> Column:
    """Bag of lower-cased tokens: bucket and sign from md5, without length normalisation. Each distinct token of an Arrow batch is hashed once."""

    @F.arrow_udf("array<double>")
    def embedded(words: pa.Array) -> pa.Array:
        own = words.flatten().dictionary_encode()
        code = np.array([int(hashlib.md5(w.encode()).hexdigest()[:6], 16) for w in own.dictionary.to_pylist()], np.int64)
        bucket, sign = code % dim, np.where(code // dim % 2 == 0, 1.0, -1.0)
        at, row = np.asarray(own.indices), np.repeat(np.arange(len(words), dtype=np.int32), np.asarray(words.value_lengths()))
        total = np.bincount(row * np.int64(dim) + bucket[at], sign[at], len(words) * dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(total))

    return embedded(tokens(F.lower(text)))
