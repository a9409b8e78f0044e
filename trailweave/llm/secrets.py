"""Secret scans: base patterns with exact spans, and multipart credentials linked within scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.work import let

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of fewer digits are never reported, and a run is always matched as a whole.
HEX = r"[0-9a-f]{24,}"
#: Parts that are reported only together: who, where and a string that may be a key.
IDENT = r"""([Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x20\x09-\x0D"'<>]*"""
#: Whole runs of 16 characters or more; those without a digit or a letter aren't weak secrets.
WEAK = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "ident", "endpoint", "weak")
SPAN = "array<struct<start:int,ord:int,stop:int>>"
_BLOCK = 64


def prefix_sums(a: Column) -> Column:
    """Sums of the first 1, 2, ... elements of an array of ints, by blocks: about linear in its size."""

    def add(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda s, v: s + v)

    def offsets(a: Column, n: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), n), lambda b: add(F.slice(a, b * _BLOCK + 1, _BLOCK))), lambda sums: F.transform(F.sequence(F.lit(0), n), lambda b: add(F.slice(sums, F.lit(1), b))))

    def sums(a: Column) -> Column:
        n = ((F.size(a) - 1) / _BLOCK).cast("int")
        return let(
            F.struct(a.alias("a"), offsets(a, n).alias("o")),
            lambda s: F.transform(s["a"], lambda _, i: let((i / _BLOCK).cast("int"), lambda b: F.get(s["o"], b) + add(F.slice(s["a"], b * _BLOCK + 1, i - b * _BLOCK + 1)))),
        )

    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(sums(a))


def find_spans(text: Column, pattern: str, kind: int, keep=None, parts=None) -> Column:
    """Leftmost non-overlapping matches of ``pattern``: start, ord and stop in code points, stop exclusive.

    ``keep``: (group, least length): matches whose group is shorter are found, then dropped; ``parts``:
    so are those in which not each of these patterns is found. Where a match begins follows from the
    lengths of all matches and of what lies between them.
    """
    rx = F.lit(pattern)
    group, least = keep or (0, 0)

    def weight(x: Column) -> Column:
        ok = F.lit(True)
        for p in parts or ():
            ok = ok & x.rlike(p)
        return F.when(ok, F.length(x)).otherwise(-1)

    def place(m: Column) -> Column:
        own = F.transform(m, lambda x: F.length(x))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        both = F.struct(own.alias("own"), gaps.alias("gaps"), F.transform(F.regexp_extract_all(text, rx, F.lit(group)), weight).alias("part"))
        return let(
            both,
            lambda s: let(
                F.struct(s["own"].alias("own"), s["part"].alias("part"), prefix_sums(F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["own"])), s["own"], lambda g, o: g + o)).alias("stop")),
                lambda t: F.filter(
                    F.transform(
                        t["stop"],
                        lambda e, i: F.struct(F.when(F.get(t["part"], i) >= least, e - F.get(t["own"], i)).otherwise(-1).alias("start"), F.lit(kind).alias("ord"), e.alias("stop")),
                    ),
                    lambda x: x["start"] >= 0,
                ),
            ),
        )

    return let(F.regexp_extract_all(text, rx, F.lit(0)), lambda m: F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(place(m).cast(SPAN)))


def link_parts(base: Column, ident: Column, endpoint: Column, weak: Column, scope: int) -> Column:
    """Spans of ident, endpoint and weak whose parts meet in one scope.

    Scope k holds the parts that start at ``k * scope`` up to ``(k + 2) * scope``: each part is in two
    scopes, and parts less than ``scope`` apart always share one. An identifier (an access span of the
    base counts as one), an endpoint and a weak secret of one scope are linked. That is a join of
    intervals on scope numbers; as no scope goes beyond a document, it joins arrays of one row, by
    hashing, and makes no pairs.
    """

    def scopes(spans: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(spans, lambda s: let((s["start"] / scope).cast("int"), lambda k: F.array(k - 1, k)))))

    def inside(spans: Column, linked: Column) -> Column:
        return F.filter(spans, lambda s: let((s["start"] / scope).cast("int"), lambda k: F.array_contains(linked, k) | F.array_contains(linked, k - 1)))

    def parts(s: Column) -> Column:
        ids = F.concat(s["ident"], F.filter(s["base"], lambda b: b["ord"] == 1))
        linked = F.array_intersect(F.array_intersect(scopes(ids), scopes(s["endpoint"])), scopes(s["weak"]))
        return let(
            F.struct(s["ident"].alias("ident"), s["endpoint"].alias("endpoint"), s["weak"].alias("weak"), linked.alias("linked")),
            lambda t: F.when(F.size(t["linked"]) == 0, F.array().cast(SPAN)).otherwise(F.concat(inside(t["ident"], t["linked"]), inside(t["endpoint"], t["linked"]), inside(t["weak"], t["linked"]))),
        )

    def free(w: Column, others: Column) -> Column:
        return F.filter(w, lambda x: ~F.exists(others, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))

    def prepared(s: Column) -> Column:
        return let(F.struct(s["base"].alias("base"), s["ident"].alias("ident"), s["endpoint"].alias("endpoint"), free(free(free(s["weak"], s["base"]), s["endpoint"]), s["ident"]).alias("weak")), parts)

    return let(F.struct(base.alias("base"), ident.alias("ident"), endpoint.alias("endpoint"), weak.alias("weak")), prepared)


def scan_secrets(text: Column, scope: int = 256) -> Column:
    """A struct of all spans of a text: base (assign, access, hex) and linked (ident, endpoint, weak).

    Weak strings (16 or more characters with a letter and a digit) and identifiers are looked for
    only in texts that also hold an endpoint; strings that overlap another span are not weak secrets.
    Null is scanned as the empty text and gives empty arrays.
    """

    def all_spans(t: Column) -> Column:
        none = F.array().cast(SPAN)
        base = F.concat(find_spans(t, ASSIGN, 0, (2, 6)), F.filter(find_spans(t, ACCESS, 1), lambda s: s["stop"] - s["start"] >= 20), find_spans(t, HEX, 2))

        def more(s: Column) -> Column:
            linked = F.when((F.size(s["endpoint"]) == 0), none).otherwise(link_parts(s["base"], find_spans(t, IDENT, 3), s["endpoint"], find_spans(t, WEAK, 5, parts=("[0-9]", "[A-Za-z]")), scope))
            return F.struct(F.sort_array(s["base"]).alias("base"), linked.alias("linked"))

        return let(F.struct(base.alias("base"), find_spans(t, ENDPOINT, 4).alias("endpoint")), more)

    return let(F.coalesce(text, F.lit("")), all_spans)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, scope: int = 256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    One pass without a shuffle. Null texts are empty; repeated rows give repeated results; other
    columns are not read; an empty table gives an empty result.
    """
    found = docs.select(docs["doc_id"].alias("doc_id"), scan_secrets(docs["text"], scope).alias("s"))

    def count(o: int) -> Column:
        return F.size(F.filter("s.base", lambda x: x["ord"] == o)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spelled(F.col("s.base")), 256).alias("base_sha256"),
        spelled(F.sort_array(F.concat("s.base", "s.linked"))).alias("spans"),
        F.size("s.linked").cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, scope: int = 256, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every base span and linked weak secret of its texts replaced by ``mark``.

    All rows and columns stay; n_chars, where there is one, becomes the new length. Spans that
    overlap or touch become one mark. Null texts stay null.
    """

    def cut(text: Column) -> Column:
        def keep(spans: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
            step = lambda a, s: F.struct(
                F.greatest(a["at"], s["stop"]).alias("at"),
                F.when((s["start"] > a["at"]) | (F.size(a["parts"]) == 0), F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"])))).otherwise(a["parts"]).alias("parts"),
            )
            rest = lambda a: F.array_join(F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), mark)
            return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))

        return let(scan_secrets(text, scope), lambda s: let(F.sort_array(F.concat(s["base"], F.filter(s["linked"], lambda x: x["ord"] == 5))), keep))

    out = docs.withColumn("text", F.when(docs["text"].isNotNull(), cut(docs["text"])))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
