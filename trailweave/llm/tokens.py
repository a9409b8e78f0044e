"""Token counts by a digest cache, and the encoder that counts and packing share."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.work import fresh_path, held, ship, split_by_bits, texts_of, written

#: Words whose ids a worker keeps at most; beyond that it forgets them and goes on.
CACHE_WORDS = 600_000
#: Bytes of text that are split into words at once.
BATCH_BYTES = 4 << 20
_TAILS = string.punctuation


class Encoder:
    """Ids of whole texts, by ``tokenizers`` for .json and ``sentencepiece`` for .model files."""

    def __init__(self, path: str) -> None:
        self.forget()
        self.split = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: np.array(model.encode(text), dtype="<u4").tobytes()
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.ids = lambda text: np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        plain = [t["content"] for t in spec.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]))]
        # White space is dropped and no rule reaches across it: what lies between can be encoded by itself.
        self.split = steps[0].get("behavior") == "Removed" and "\\s" in json.dumps(steps[0]) and bool((spec["model"].get("end_of_word_suffix"))) and len(plain) == len(spec.get("added_tokens", []))
        if self.split:
            end = spec["model"]["end_of_word_suffix"]
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.last[[i for w, i in vocab.items() if w.endswith(end)]] = True

    def forget(self) -> None:
        """Word -> number; the ids of word i are pool[begin[i] : begin[i + 1]]. Word 0 is empty."""
        self.words: dict[str, int] = {"": 0}
        self.begin = np.zeros(2, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, words: list[str], plain: bool) -> None:
        """Keeps the ids of new words. ``plain``: of lower-case letters only; these are encoded many at a time."""
        lens, ids = [], []
        for i in range(0, len(words), 1024 if plain else 1):
            part = words[i : i + (1024 if plain else 1)]
            got = np.array(self.lib.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1 if plain else [len(got)]
            if len(ends) != len(part):  # a word that isn't one run of letters for the library
                each = [np.frombuffer(self.ids(w), "<u4") for w in part]
                got, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            lens.append(np.diff(ends, prepend=0))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(lens))])
        self.pool = np.concatenate([self.pool, *ids])

    def numbers(self, words: list[str], plain: bool) -> np.ndarray:
        get = self.words.get
        out = [get(w, -1) for w in words]
        new = list(dict.fromkeys(w for w, i in zip(words, out) if i < 0))
        if new:
            self.learn(new, plain)
            get = self.words.__getitem__
            out = [get(w) if i < 0 else i for w, i in zip(words, out)]
        return np.array(out, np.int64)

    def chunks_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk two words whose ids, one after the other, are its own.

        Letters and then ASCII punctuation are two runs for the library, whatever they are; the case
        of A-Z doesn't matter to it where only letters stand. Other chunks are words by themselves.
        """
        core = pc.utf8_rtrim(chunks, characters=_TAILS)
        alpha = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        letters = pc.ascii_lower(core.filter(pa.array(alpha)))
        first[alpha] = self.numbers(letters.to_pylist(), True)
        odd = pc.not_equal(pc.binary_length(chunks), pc.binary_length(core)).to_numpy(zero_copy_only=False) & alpha
        at = np.flatnonzero(odd)
        cut = pc.binary_length(core).to_numpy(zero_copy_only=False)[at].tolist()
        second[at] = self.numbers([c.encode()[n:].decode() for c, n in zip(chunks.take(pa.array(at)).to_pylist(), cut)], False)
        first[~alpha] = self.numbers(chunks.filter(pa.array(~alpha)).to_pylist(), False)
        return first, second

    def _batch(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.forget()
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        codes = parts.values.dictionary_encode()
        first, second = self.chunks_of(codes.dictionary)
        code = codes.indices.to_numpy(zero_copy_only=False)
        # The words of all chunks in turn, and from them the ids.
        pair = np.stack([first, second], axis=1)[code].ravel()
        lens = (self.begin[1:] - self.begin[:-1])[pair]
        ends = np.cumsum(lens)
        ids = self.pool[np.repeat(self.begin[pair] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4").tobytes()
        stops = np.concatenate([[0], ends])[2 * parts.offsets.to_numpy()] * 4
        stops = stops.tolist()
        for a, b in zip(stops, stops[1:]):
            yield ids[a:b]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit numbers."""
        if not self.split:
            yield from map(self.ids, texts)
            return
        batch, size = [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                yield from self._batch(batch)
                batch, size = [], 0
        if batch:
            yield from self._batch(batch)


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


def version_of(path: str) -> str:
    """A digest of the tokenizer's file: counts of another version are never reused."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from trailweave.llm.tokens import encoder

        enc = encoder(path)
        for b in batches:
            n = [len(x) // 4 for x in enc.encode(texts_of(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return count


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    The digest of a document is the SHA-256 of its content after the tokenizer's version; content is
    normalised in as far as that can't change a count: null becomes the empty text. ``cache`` is a
    folder of Parquet files (digest, n_tokens) that every reader of the cluster sees; without one,
    a new cache is begun. Digests that the cache lacks are encoded once each, and appended; then all
    documents take their counts from the cache. Texts whose digest surely occurs once and isn't cached,
    by bitmaps of the others (see split_by_bits), are encoded where they are read. Of the rest one row
    of each digest that the cache lacks is found by a join, which brings its text along.

    Repeated rows give repeated results, null ids stay, an empty table gives an empty result, and
    other columns are not read. If two runs append the same digest at once, readers take one of the
    equal counts.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    cache = cache or fresh_path(spark, "token-cache")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.unhex(F.sha2(F.concat(F.lit(version_of(tokenizer)), text), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    meta = written(rows.select("doc_id", "digest", "n_bytes"), "token-rows")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.read.schema("digest binary, n_tokens long").parquet(cache) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], "digest binary, n_tokens long")
    per = written(meta.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).join(known.withColumn("cached", F.lit(True)), "digest", "left"), "token-digests")
    alone, maybe = split_by_bits(rows, "digest", written(per.where("n > 1 OR cached").select("digest").distinct(), "token-shared"))
    # A digest's text comes from the rows with its smallest doc_id; where that is null, from all its rows.
    wanted = per.where("cached IS NULL").select(F.col("digest").alias("d"), "first_id")
    first = maybe.join(wanted, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    fresh = alone.unionByName(first).select("digest", "text").mapInArrow(_counter(tokenizer), "digest binary, n_tokens long")
    fresh.dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    counts = spark.read.schema("digest binary, n_tokens long").parquet(cache).join(meta.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    # Written, so that the join reads two plain exchanges and can split that of a hot digest; and a
    # cache of many runs brings along what these documents need.
    counts = written(counts, "token-counts")
    return meta.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
