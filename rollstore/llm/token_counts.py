"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, tokens).  Documents
join it by digest; of what it lacks, each distinct content is encoded once and appended.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import DIGIT, LETTER, vocabulary
from .common import Scratch, slices, text_or_empty
from .rows import Rows

#: Characters on whose case, class and composition every Unicode version agrees.
PLAIN = re.compile(r"[\t\n\v\f\r -~¡-įı-ňŊ-ž]*")
#: The split of the word vocabulary over those characters.
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")
#: Fixed value: the split pattern that the word vocabulary declares.
DECLARED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words remembered by a worker before it starts anew.
CACHE_WORDS = 1 << 19

_counters: dict[str, Counter] = {}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts the tokens of texts as the library of the vocabulary file does."""

    def __init__(self, path: str):
        self.words: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.by_word = False
            return
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.whole = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.by_word = self._splits_words(spec)

    @staticmethod
    def _splits_words(spec: dict) -> bool:
        """Whether the vocabulary lower-cases, splits by DECLARED and drops the rest, so that words count alone."""
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": DECLARED}
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and not spec.get("post_processor")
        )

    def count(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        split: dict[int, list[str]] = {}
        rest: list[int] = []
        for i, t in enumerate(texts):
            if self.by_word and PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                split[i] = PLAIN_WORDS.findall(t.lower())
            else:
                rest.append(i)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new = list(set().union(*split.values()).difference(self.words)) if split else []
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.words.update(zip(some, self.whole(some), strict=True))
        for i, words in split.items():
            out[i] = sum(map(self.words.__getitem__, words))
        for i in rest:
            out[i] = self.whole([texts[i]])[0]
        return out


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame,
    path: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 2048,
    normalise=None,
) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``cache`` is a folder that driver and executors share; it is made if missing and grows
    by the distinct contents that it lacked, under this vocabulary file's digest.  Digests
    meet the cache; of the contents that it lacks, one row each is marked, and encoded where
    it lies, so that copies, however many, are encoded once and no text is shuffled.  A null
    text counts as empty: 0 bytes.  ``normalise`` (a Column function) may map texts of one
    count to one content.  Rows repeated with one id give a row each.  An empty table gives
    no rows.  Other columns are ignored.  Two runs that append the same content at one time
    are harmless: the counts are equal and are read once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    version = file_digest(path)
    rows = Rows(docs, scratch)
    whole = text_or_empty(text_col)
    content = whole if normalise is None else F.coalesce(normalise(F.col(text_col)), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("content")
    keyed = scratch.save(rows.df.select(F.col(id_col).alias("_id"), F.octet_length(whole).cast("long").alias("n_bytes"), digest, *rows.place()), "digests")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in slices(batches, "_t", 2 << 20):
            yield pa.RecordBatch.from_pydict({"content": batch.column("content"), "n_tokens": pa.array(c.count(batch.column("_t").to_pylist()), pa.int64())})

    schema = "content binary, n_tokens long, tokenizer string"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def known() -> DataFrame:
        found = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == version)
        return found.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    first = keyed.groupBy("content").agg(F.min(F.struct("file", "row")).alias("first"))
    misses = first.join(known().select("content"), "content", "left_anti") if exists else first
    marked = misses.select("first.file", "first.row", F.lit(1).alias("value"))
    texts = rows.decided(marked, lambda df, v: df.where(F.col(v) == 1).select(digest, content.alias("_t")), name="misses")
    found = texts.mapInArrow(count, "content binary, n_tokens long").withColumn("tokenizer", F.lit(version))
    # Laid out by vocabulary, so that a run reads the counts of its own.
    found.write.mode("append").partitionBy("tokenizer").parquet(cache)
    # Unique by content and read from a table, so that the rows of a hot content can be split.
    counts = scratch.save(known(), "counts")
    out = keyed.join(counts, "content").select("_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return scratch.finish(out).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # A cache of its own for each run, so that a result never rests on an earlier run.
    return count_tokens(docs, vocabulary("word_bpe_49k.json"), Scratch(spark, "tokens").path("cache"))
