"""Sliding token windows over documents, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.scalars import WHITE, chunk_hash, chunk_id, words


@dataclass(frozen=True)
class ChunkStrategy:
    strategy_name: str
    version: str
    chunk_size_tokens: int
    chunk_overlap_tokens: int = 0
    splitter_type: str = "recursive_character"
    tokenizer: str = "whitespace"

    def __post_init__(self):
        if self.chunk_size_tokens < 1 or not 0 <= self.chunk_overlap_tokens < self.chunk_size_tokens:
            raise ValueError("a window needs a positive size and an overlap below it")

    @classmethod
    def from_yaml(cls, path: str) -> ChunkStrategy:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        if lacking := [k for k in ("strategy_name", "version", "splitter_type", "chunk_size_tokens", "chunk_overlap_tokens", "tokenizer") if k not in raw]:
            raise ValueError(f"strategy lacks {lacking}")
        return cls(**{k: raw[k] for k in ("strategy_name", "version", "chunk_size_tokens", "chunk_overlap_tokens", "splitter_type", "tokenizer")})


def window_starts(n: Column, strategy: ChunkStrategy) -> Column:
    """First tokens of the windows over n tokens: each a step on, the last one being the first to reach the end."""
    step = strategy.chunk_size_tokens - strategy.chunk_overlap_tokens
    more = F.ceil(F.greatest(F.lit(0), n - strategy.chunk_size_tokens) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), more), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def _tokens(tokenize: Callable[[list[str]], list[list[str]]] | None) -> Column:
    if tokenize is None:
        return words(F.col("text"))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenize(texts.tolist()), dtype=object)

    return cut("text")


def chunk_documents(df: DataFrame, strategy: ChunkStrategy, tokenize: Callable[[list[str]], list[list[str]]] | None = None, joiner: str = " ") -> DataFrame:
    """Chunks of documents (doc_id, text and, if there, doc_version and pii_masked_flag).

    Empty, blank and null texts have none. Tokens are split once for each document, and only its windows are rebuilt. Without
    `tokenize`, a plug that cuts a batch of texts into tokens which `joiner` joins again, tokens are runs without white space."""
    if lacking := [c for c in ("doc_id", "text") if c not in df.columns]:
        raise ValueError(f"documents lack {lacking}")
    version = F.col("doc_version") if "doc_version" in df.columns else F.lit(1)
    flag = F.col("pii_masked_flag") if "pii_masked_flag" in df.columns else F.lit(False)
    spoken = F.col("text").rlike(f"[^{WHITE}]")  # cheaper than splitting twice
    tokens = df.filter(spoken).select("doc_id", version.alias("doc_version"), flag.alias("pii_masked_flag"), _tokens(tokenize).alias("tokens"))
    size = F.lit(strategy.chunk_size_tokens)
    cut = lambda i: F.slice("tokens", i + 1, size)
    windows = F.transform(window_starts(F.size("tokens"), strategy), lambda i: F.struct(i.alias("token_start"), F.size(cut(i)).alias("n_tokens"), F.array_join(cut(i), joiner).alias("chunk_text")))
    parts = tokens.select("doc_id", "doc_version", "pii_masked_flag", F.posexplode(windows).alias("chunk_index", "w")).select("*", "w.*")  # windows leave, the token list stays
    text = F.col("chunk_text")
    return parts.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "doc_version", "chunk_index", "token_start", "n_tokens", "chunk_text",
        chunk_hash(text, F.lit(strategy.version)).alias("chunk_hash"), F.lit(strategy.strategy_name).alias("strategy_name"), F.lit(strategy.version).alias("strategy_version"), F.lit(strategy.tokenizer).alias("tokenizer_name"), "pii_masked_flag")
