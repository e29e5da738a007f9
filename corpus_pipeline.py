"""Training-corpus pipeline: each stage takes what the one before kept."""

from __future__ import annotations

import public_tokenizers

from censusloom.llm import minhash, packing, quality, repeats, secrets
from censusloom.llm.common import cut, table

#: Five words and a similarity of 0.8 or more.
ALIKE = minhash.Likeness(width=5, percent=80, rows=5)


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return minhash.keep_one(docs, ALIKE)


def repeated_passages(spark, docs, sf_dir):
    """Passages that repeat across documents stay only where they come first."""
    return repeats.cut_repeats(docs)


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked."""
    return secrets.mask(docs)


def pack(spark, docs, sf_dir):
    """What is left is packed into windows of token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("pack", pack),
]
#: Forests, permutations and tokens can't be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
