"""Mix sources to target weights, small sources repeated up to a cap.

Method: count the tokens of every text with a public tokenizer, sum them by source, derive a
repetition rate for each source, then emit each document ``floor(rate)`` times plus one
hash-seeded Bernoulli copy whose probability is the fraction of the rate.

The total size is the largest at which every source that has text can give its share within
its cap: T = min(cap * tokens / share); rate = share * T / tokens. Shares of sources without
text cannot be met; the others keep their proportions to each other.

Defined results for unusual input: null or empty texts, null sources, sources without a
target, targets with a null or non-positive share or a cap under 1 take no part; a source
listed twice counts with the sum of its shares and its smallest cap; an empty table gives an
empty selection; repeated documents are documents of their own; further columns are carried
along unless they clash with ``n_tokens``, ``rate``, ``copy_no`` or ``tokenizer``, whose input
versions are dropped.

Scale: tokens are counted in one narrow Arrow pass and written once as (id, source, count);
the only shuffle is the partial sum of one row a source and task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.session import cut

#: File of a public tokenizer in tiktoken's rank format, and the pattern that goes with it.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoder(path: str = DEFAULT_TOKENIZER):
    """The tokenizer, loaded once a Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, text_col: str, keep: list[str], tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each row's whole text; the text itself goes no further."""
    schema = df.select(*keep).schema.add("n_tokens", "long")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], schema=arrow)

    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def rates(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source with target and text: share, cap, tokens held, wanted share, rate."""
    t = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap"))
    held = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).filter("tokens > 0")
    s = t.join(held, "source")
    total = F.min(F.col("cap") * F.col("tokens") / F.col("share")).over(Window.partitionBy(F.lit(1)))  # one row a source
    return s.withColumn("rate", F.least(F.col("cap").cast("double"), F.col("share") * total / F.col("tokens")))


def mix_sources(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, tokenizer: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). Selection: one row a copy with id, source, copy_no (from 1), n_tokens
    and the tokenizer's name. Shares: by source the target, rate, tokens and share reached;
    sources with a target but without text are listed with nothing reached."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("__text")).filter("__text IS NOT NULL AND __text <> '' AND source IS NOT NULL")
    wanted = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").select("source").distinct()
    rows = rows.join(wanted, "source", "left_semi")
    counted = cut(count_tokens(rows, "__text", ["id", "source"], tokenizer))
    rate = cut(rates(counted, targets))
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string"), "source"), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    copies = F.least(F.col("cap"), F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    chosen = counted.join(rate.select("source", "rate", "cap"), "source").withColumn("copies", copies).filter("copies > 0")
    name = os.path.basename(tokenizer)
    selection = chosen.select("id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens", F.lit(name).alias("tokenizer"))
    got = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_reached"), F.sum("copies").alias("copies_reached"), F.max("copies").alias("most_repeats"))
    whole = F.sum("tokens_reached").over(Window.partitionBy(F.lit(1)))  # one row a source
    asked = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    shares = (
        asked.join(rate.select("source", "tokens", "rate"), "source", "left")
        .join(got, "source", "left")
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens_held"), "rate", F.coalesce("copies_reached", F.lit(0)).alias("copies"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("tokens_reached", F.lit(0)).alias("tokens_reached"), (F.coalesce("tokens_reached", F.lit(0)) / whole).alias("share_reached"), F.lit(name).alias("tokenizer"))
    )
    return selection, shares
