"""WARC archives: written as text files with the record end as separator, read back by boundary chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.llm.work import ship, split_by_bits, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: A fixed date, so that equal pages make equal archives.
DATE = "2024-01-01T00:00:00Z"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(c: Column) -> Column:
    """The SHA-1 of a string's UTF-8, in base 32 (RFC 4648)."""
    h = F.sha1(c)
    groups = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to .txt part files below ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest page_id
    are responses and carry the payload; the others are revisits that name it and carry none. All
    rows that repeat the smallest page_id are responses. Rows with a null page_id have no id in the
    archive; if all rows of a payload are such, all are responses.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    url = F.regexp_replace(F.coalesce(pages["url"].cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("url"), base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n"), html.alias("html"))
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    first = written(first.where("copies > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("d"), "first_id"), "warc-copies")
    alone, maybe = split_by_bits(rows, "digest", first.select(F.col("d").alias("digest")))
    # Of rows that may have copies, revisits move without their texts.
    slim = maybe.drop("html").join(first, F.col("digest") == F.col("d")).where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    revisits = slim.select("page_id", "url", "digest", "n", "first_id", F.lit(None).cast("string").alias("html"))
    responses = maybe.join(first, (F.col("digest") == F.col("d")) & ~F.col("page_id").eqNullSafe(F.col("first_id")), "left_anti").unionByName(alone)
    responses = responses.select("page_id", "url", "digest", "n", F.lit(None).cast("long").alias("first_id"), "html")
    responses.unionByName(revisits).select(_record().alias("value")).write.option("lineSep", END).text(path)


def _record() -> Column:
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    again = F.col("first_id").isNotNull()
    opt = lambda when, c: F.when(when, c).otherwise("")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        opt(F.col("page_id").isNotNull(), line("WARC-Record-ID", urn(F.col("page_id")))),
        opt(again, line("WARC-Refers-To", urn(F.col("first_id")))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Length", F.when(again, 0).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
        F.coalesce("html", F.lit("")),
    )


def _chain(local: bool):
    """Follows chains through the candidates of one split. Columns file, split, start, stop, at, next."""

    def jump(at: np.ndarray, nxt: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """For each candidate the first offset beyond the split that its chain comes to (-1: it breaks)."""
        n = len(at)
        k = np.searchsorted(at, nxt)
        hit = (k < n) & (at[np.minimum(k, n - 1)] == nxt) if n else np.zeros(0, bool)
        exit_ = np.where(nxt >= stop, nxt, -1)
        to = np.where(hit & (nxt < stop), k, np.arange(n))
        while True:  # pointer jumping: the length of a jump doubles
            new = to[to]
            if (new == to).all():
                break
            to = new
        return to, np.where(exit_[to] >= 0, exit_[to], -1)

    def exits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        _, out = jump(rows["at"].to_numpy(), rows["next"].to_numpy(), int(rows["stop"].iloc[0]))
        return pd.DataFrame({"file": rows["file"], "at": rows["at"], "exit": out})

    def reached(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        at, nxt = rows["at"].to_numpy(), rows["next"].to_numpy()
        n = len(at)
        k = np.searchsorted(at, nxt)
        hit = (k < n) & (at[np.minimum(k, n - 1)] == nxt)
        seen = rows["entry"].to_numpy().copy()
        to = np.where(hit, k, np.arange(n))
        while True:  # what is reached in 2**i steps reaches what lies 2**i steps further
            new = seen.copy()
            new[to[seen]] = True
            if (new == seen).all() and (to[to] == to).all():
                break
            seen, to = new, to[to]
        return rows.loc[seen, ["file", "split", "mid", "at"]]

    return exits if local else reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Files are read by the line reader with the magic as separator, in splits of any size; so what
    follows each magic, be it a record or a piece of a payload, is one row, and the lengths of rows
    give the offsets of magics. Each such row that parses as a header is a candidate with a successor:
    the end of the record it announces. Candidates of a split are joined into chains by pointer
    jumping, splits of a file likewise, and only what the start of the file reaches is a record; so a
    magic, or a whole record, inside a payload is rejected. A payload with magics in it is put
    together again from its rows.

    Broken files: what the start doesn't reach is left out. Payload digests are computed from the
    payloads; revisits carry those of what they refer to. Records without an id, or that name none
    they refer to, have nulls there; a folder of empty files gives an empty result.
    """
    ship(spark)
    lines = _lines(spark, path)
    cut = F.locate(END, F.col("value"))
    head = F.when(cut > 0, F.substring(F.col("value"), 1, cut - 1)).otherwise("")
    field = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    parsed = lines.withColumn("head", head).withColumn("bytes", F.octet_length("value").cast("long"))
    parsed = parsed.select(
        "file", "split", "mid", "bytes", "value",
        (F.octet_length("head") + 4).cast("long").alias("head_bytes"),
        number(field("Content-Length")).alias("content"),
        field("WARC-Type").alias("kind"),
        number(F.regexp_extract(field("WARC-Record-ID"), "<urn:page:(-?[0-9]+)>", 1)).alias("page_id"),
        number(F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1)).alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha1:([A-Z2-7]+)", 1).alias("told_digest"),
        number(field("X-Payload-Length")).alias("told_bytes"),
    )
    whole = (F.col("content") + F.col("head_bytes") + len(END)) == F.col("bytes")
    payload = F.when(whole, F.substring(F.col("value"), F.locate(END, F.col("value")) + len(END), F.length("value") - F.locate(END, F.col("value")) - 2 * len(END) + 1))
    meta = written(
        parsed.select(
            *[c for c in parsed.columns if c != "value"],
            whole.alias("whole"),
            F.when(whole & (F.col("kind") != "revisit"), base32_sha1(payload)).alias("digest"),
        ),
        "warc-lines",
    )
    at = _placed(meta)
    rows = written(at.withColumn("next", F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("content") + len(END)).withColumn("stop", F.col("begin") + F.col("n") - len(MAGIC)), "warc-rows")
    cand = rows.where("at >= 0 AND content IS NOT NULL").select("file", "split", "mid", "at", "next", "stop")
    exits = written(cand.groupBy("file", "split").applyInPandas(_chain(True), "file string, at long, exit long"), "warc-exits")
    # From the file's start over splits: entries reached so far, and where jumps of 2**i splits lead.
    jumps, entries = exits.where("exit >= 0"), exits.where("at = 0").select("file", "at")
    count = 1
    while True:
        more = entries.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))
        entries = written(entries.unionByName(more).distinct(), "warc-entries")
        now = entries.count()
        if now == count:
            break
        count = now
        b = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
        jumps = written(jumps.join(b, ["file", "exit"]).select("file", "at", F.col("further").alias("exit")), "warc-jumps")
    marked = cand.join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left").fillna({"entry": False})
    good = marked.groupBy("file", "split").applyInPandas(_chain(False), "file string, split long, mid long, at long")
    records = written(rows.join(good, ["file", "split", "mid", "at"]), "warc-records")
    done = records.where("whole OR kind = 'revisit'")
    kinds = [F.when(F.col("kind") == "revisit", F.col("told_bytes")).otherwise(F.col("content")).alias("payload_bytes"), F.when(F.col("kind") == "revisit", F.col("told_digest")).otherwise(F.col("digest")).alias("payload_digest")]
    out = done.select("page_id", *kinds, F.col("kind").alias("record_type"), "refers_to")
    broken = records.where("NOT whole AND kind <> 'revisit'").select("file", "at", "next", "page_id", "kind", "content", "refers_to")
    if not broken.isEmpty():
        out = out.unionByName(_rejoined(lines, broken))
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic of the files: value, and where it was read: file, split, mid (its order in the split)."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("mid"))


def _placed(meta: DataFrame) -> DataFrame:
    """Adds ``at``, the offset in the file of the magic before each row, and of its split ``begin`` and length ``n``.

    ``meta`` (file, split, mid, bytes) must have been written: splits and orders hold for one reading
    only, as split sizes follow the session and the executors at hand. Offsets hold for all readings.
    The row before the first magic of a file is empty: its offset is 0, and every other row follows a
    magic.
    """
    size = F.col("bytes") + len(MAGIC)
    per = meta.groupBy("file", "split").agg(F.sum(size).alias("n"))
    # Splits of a file, not their rows, meet in a task here.
    per = per.select("file", "split", (F.sum("n").over(W.partitionBy("file").orderBy("split")) - F.col("n")).alias("begin"), "n")
    within = F.sum(size).over(W.partitionBy("file", "split").orderBy("mid")) - size
    return meta.withColumn("within", within).join(per, ["file", "split"]).withColumn("at", F.col("begin") + F.col("within") - len(MAGIC)).drop("within")


def _rejoined(lines: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payloads hold magics: their rows are brought together again, in order.

    Only now is it known which rows these are, so the files that have such records are read once more
    and written row by row. This reading's splits may be others than the first one's; rows meet their
    records by offsets in the file, which are worked out for this reading anew.
    """
    spans = broken.select("file", F.col("at").alias("from_at"), "next", "page_id", "kind", "content", "refers_to")
    again = written(lines.join(spans.select("file").distinct(), "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long")), "warc-texts")
    step = 1 << 22
    cells = spans.withColumn("cell", F.explode(F.sequence((F.col("from_at") / step).cast("long"), (F.col("next") / step).cast("long"))))
    placed = _placed(again.select("file", "split", "mid", "bytes")).select("file", "split", "mid", "at", (F.col("at") / step).cast("long").alias("cell"))
    inner = placed.join(cells, ["file", "cell"]).where("at >= from_at AND at < next")
    text = inner.join(again.drop("bytes"), ["file", "split", "mid"])
    whole = text.groupBy("file", "from_at", "next", "page_id", "kind", "content", "refers_to").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    head = F.locate(END, F.col("value"))
    body = F.substring(F.col("value"), head + len(END), F.length("value") - head - 2 * len(END) + 1)
    return whole.select("page_id", F.col("content").alias("payload_bytes"), base32_sha1(body).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def warc_round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes the pages to archives below ``path`` and reads them back: one row a page.

    Null html is empty; null ids stay; repeated rows have a record each; other columns are not
    written; an empty table gives an empty result.
    """
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
