"""Token counts kept by signed deltas.

Totals of documents and tokens by source, language and tokenizer version are
sums, so a change is a small table of signed amounts: an insert adds, a delete
subtracts, a revision subtracts the old count and adds the new.  ``Rollup``
stores each batch of changes under its name; a batch that is already committed
is skipped, so repeating a job changes nothing, and one that died half-way is
written again from the start.  Reading sums the committed batches;
``compact`` folds them into one.

Tokens are counted over whole texts on the executors.  A vocabulary is read once
on the driver from the path it is given and sent to them.

Defined results: a null or empty text has 0 tokens and is a document; null
sources and languages are groups of their own; repeated rows count each time;
groups whose documents and tokens are both 0 are left out; an empty table gives
an empty delta; other columns of the input are ignored.  ``report`` counts equal
texts once, for the row of least id, source and language, nulls last.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Mapping
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.runtime import materialize
from gaugeflow.llm.words import NOT_SPACE, Words, column_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts a text before merging; a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]

Counter = Callable[[pa.Array], list[int]]


@cache
def _encoding(vocabulary: bytes):
    import tiktoken

    lines = (line.split() for line in vocabulary.splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def words() -> Counter:
    """Counts words between white space."""
    return lambda texts: Words(*column_bytes(texts), NOT_SPACE).counts().tolist()


def byte_bpe(spark: SparkSession, path: str = VOCABULARY) -> Counter:
    """Counts tokens of the byte-level vocabulary at ``path``."""
    sent = spark.sparkContext.broadcast(Path(path).read_bytes())  # one vocabulary, some hundred KB

    def count(texts: pa.Array) -> list[int]:
        encode = _encoding(sent.value).encode_ordinary
        return [len(encode(t)) if t else 0 for t in texts.to_pylist()]

    return count


def counted(docs: DataFrame, tokenizers: Mapping[str, Counter], *, text_col: str = "text") -> DataFrame:
    """A row per row of ``docs`` and tokenizer: its columns but the text, tokenizer and tokens."""
    keep = [c for c in docs.columns if c != text_col]
    at = docs.columns.index(text_col)
    names = list(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in names:
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(k) for k in range(batch.num_columns) if k != at],
                        pa.array([name] * batch.num_rows, pa.string()),
                        pa.array(tokenizers[name](batch.column(at)), pa.int64()),
                    ],
                    names=[*keep, "tokenizer", "tokens"],
                )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{columns}, tokenizer string, tokens long")


def delta(counts: DataFrame, documents: Column | int, tokens: Column) -> DataFrame:
    """Signed amounts by ``KEYS`` from rows with these columns."""
    documents = documents if isinstance(documents, Column) else F.lit(documents)
    rows = counts.select(*KEYS, documents.cast("long").alias("documents"), tokens.cast("long").alias("tokens"))
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def inserts(counts: DataFrame) -> DataFrame:
    return delta(counts, 1, F.col("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return delta(counts, -1, -F.col("tokens"))


def revisions(counts: DataFrame, old: str, new: str) -> DataFrame:
    """From rows that carry a document's ``old`` and ``new`` count."""
    return delta(counts, 0, F.col(new) - F.col(old))


class Rollup:
    """Totals below ``path``, changed by named batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def _stored(self, kind: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not self._fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(root))
        return [n for n in names if self._exists(f"{self.path}/{kind}/{n}/_SUCCESS")]

    def folded(self) -> str | None:
        """The latest snapshot."""
        return max(self._stored("snapshots"), default=None)

    def batches(self) -> list[str]:
        """Committed batches that are not in the latest snapshot."""
        return [b for b in self._stored("batches") if not self._in_snapshot(b)]

    def _in_snapshot(self, batch: str) -> bool:
        latest = self.folded()
        return latest is not None and self._exists(f"{self.path}/contents/{latest}/{batch}")

    def commit(self, batch: str, change: DataFrame) -> bool:
        """Store ``change`` as ``batch``; False, and nothing is done, if it has been committed."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"a batch's name has letters, digits and hyphens: {batch!r}")
        if batch in self._stored("batches"):
            return False
        change.select(*KEYS, *SUMS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version."""
        latest = self.folded()
        paths = [f"{self.path}/snapshots/{latest}"] if latest else []
        paths += [f"{self.path}/batches/{b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, documents long, tokens long")
        summed = self.spark.read.parquet(*paths).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.where("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; they stay known, so none is applied twice."""
        latest, held = self.folded(), self._stored("batches")
        name = f"{int(latest or '0') + 1:08d}"
        totals = self.totals()
        for batch in held:
            self._fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/contents/{name}/{batch}"))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}")


def report(docs: DataFrame, path: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals of the distinct texts of ``docs``, reached by four batches.

    Documents are inserted with their word count as a provisional count of every
    tokenizer; the batch is delivered twice and counted once; the counts are
    revised to the tokenizers' own; and documents whose text an earlier one has
    are deleted.
    """
    spark = docs.sparkSession
    light = docs.select(
        "doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    )
    tokenizers = {"words/1": words(), "byte_bpe_50k/1": byte_bpe(spark, vocabulary)}
    counts = materialize(counted(light, tokenizers), "token-counts")
    provisional = (
        counts.groupBy("doc_id", "source", "lang", "digest")
        .agg(
            F.sum(F.when(F.col("tokenizer") == "words/1", F.col("tokens"))).alias("first_tokens"),
            F.sum(F.when(F.col("tokenizer") != "words/1", F.col("tokens"))).alias("own_tokens"),
            F.count_if(F.col("tokenizer") == "words/1").alias("rows"),
        )
    )
    by_tokenizer = provisional.withColumn("tokenizer", F.explode(F.array(*[F.lit(n) for n in tokenizers]))).withColumn(
        "tokens", F.when(F.col("tokenizer") == "words/1", F.col("first_tokens")).otherwise(F.col("own_tokens"))
    )
    by_tokenizer = materialize(by_tokenizer, "by-tokenizer")
    rollup = Rollup(spark, path)
    inserted = delta(by_tokenizer, F.col("rows"), F.col("first_tokens"))
    rollup.commit("1-insert", inserted)
    rollup.commit("1-insert", inserted)
    rollup.commit("2-revise", revisions(by_tokenizer, "first_tokens", "tokens"))
    # of the rows of equal texts one stays, in a total order
    order = F.struct(*[x for c in ("doc_id", "source", "lang") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    ranked = by_tokenizer.withColumn("order", order)
    firsts = ranked.groupBy("tokenizer", "digest").agg(F.min("order").alias("least"))
    kept = ranked.join(firsts, ["tokenizer", "digest"]).withColumn(
        "gone", F.when(F.col("order").eqNullSafe(F.col("least")), F.col("rows") - 1).otherwise(F.col("rows"))
    )
    rollup.commit("3-delete", delta(kept, -F.col("gone"), -F.col("gone") * F.floor(F.col("tokens") / F.col("rows"))))
    return rollup.totals()
