"""Texts cut off by field limits: hidden limits from length histograms, then the endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.session import small, written

#: A spike in a length histogram: at least so many texts, so many times the mean of the lengths around it, and so
#: many deviations above that mean.
LEAST_AT_LIMIT, TIMES_AROUND, DEVIATIONS, AROUND = 5, 12.0, 8.0, 50
#: A last line is an appended trailer if it recurs in so many texts and in this share of its source, or of all texts.
LEAST_TRAILERS, TRAILER_SHARE, TRAILER_SHARE_ALL = 3, 0.02, 0.001
#: Up to this many sources the per-source findings are broadcast (200 short lines each at most).
MAX_BROADCAST_SOURCES = 1000


def _count(c: Column, what: str) -> Column:
    """How often a one-byte string occurs; bytes, as those lengths need no scan."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(what)))


def _trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(" \n\r\t\f\x0b"))


#: Characters whose escaped form is longer.
COUNTED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "back": "\\", "nl": "\n", "cr": "\r", "tab": "\t", "pair": "\r\n"}


def length_counts(text: str) -> dict[str, Column]:
    """Characters, bytes and the counts from which all lengths follow: one pass over the text each."""
    t = F.col(text)
    counts = {f"_{n}": (_count(t, c) / len(c)).cast("int") for n, c in COUNTED.items()}
    wide, high = F.regexp_replace(t, r"[\x{0}-\x{7F}]+", ""), F.regexp_replace(t, r"[\x{0}-\x{FFFF}]+", "")
    return {"_chars": F.length(t), "_utf8": F.octet_length(t), "_wide": F.length(wide), "_high": F.length(high)} | counts


def length_metrics() -> dict[str, Column]:
    """Length of the text as it is and as it would be stored under other encodings, escapings and line ends."""
    c = {n: F.col(f"_{n}") for n in ("chars", "utf8", "wide", "high", *COUNTED)}
    html, quoted = 4 * c["amp"] + 3 * c["lt"] + 3 * c["gt"], 5 * c["quot"] + 4 * c["apos"]
    json, crlf = c["quot"] + c["back"] + c["nl"] + c["cr"] + c["tab"], c["nl"] - c["pair"]
    return {
        "chars": c["chars"],
        "utf8": c["utf8"],
        "utf16": c["chars"] + c["high"],
        "html_chars": c["chars"] + html,
        "html_utf8": c["utf8"] + html,
        "html_quoted_chars": c["chars"] + html + quoted,
        "html_quoted_utf8": c["utf8"] + html + quoted,
        "json_chars": c["chars"] + json,
        "json_utf8": c["utf8"] + json,
        "json_ascii": c["chars"] + json + 5 * c["wide"] + 6 * c["high"],
        "crlf_chars": c["chars"] + crlf,
        "crlf_utf8": c["utf8"] + crlf,
        "lf_chars": c["chars"] - c["pair"],
        "lf_utf8": c["utf8"] - c["pair"],
    }


METRICS = [
    "chars", "utf8", "utf16", "html_chars", "html_utf8", "html_quoted_chars", "html_quoted_utf8", "json_chars", "json_utf8", "json_ascii",
    "crlf_chars", "crlf_utf8", "lf_chars", "lf_utf8",
]


def text_features(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Per text: its lengths under all metrics, the whole of it as _end, line ends as \\n and trailing white space removed, and
    _tail, the last line where it may be a trailer: it stands apart and closes nothing."""
    m = length_metrics()
    base = docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    end = _trim_end(F.replace(F.col("_text"), F.lit("\r\n"), F.lit("\n")))
    counted = base.select("_k", "_s", F.xxhash64("_text").alias("_h"), end.alias("_end"), *[c.alias(n) for n, c in length_counts("_text").items()])
    tail = F.when((F.col("_end") != "") & _line_is_apart("_end") & ~_last_line("_end").rlike(CLOSER), F.trim(_last_line("_end")))
    return counted.select("_k", "_s", "_h", F.array(*[m[x].cast("int") for x in METRICS]).alias("_len"), "_end", tail.alias("_tail"))


def _stands_out(n: Column, mean: Column) -> Column:
    return (n >= LEAST_AT_LIMIT) & (n >= TIMES_AROUND * mean) & (n >= mean + DEVIATIONS * F.sqrt(mean + F.lit(0.3)))


def storage_limits(features: DataFrame) -> DataFrame:
    """(source, metric, length, texts): lengths at which a source's texts pile up under the metric that shows it best.

    Lengths are counted per (source, metric), copies of one text once; a spike stands out from the counts around it. A text that lies on
    spikes of several metrics counts for the largest alone, and a spike must stand out by these texts again, so
    an escaping that merely follows another limit drops out. The histogram is aggregated partially; its size is
    bounded by the lengths that occur.
    """
    once = features.where(F.element_at("_len", 1) > 0).dropDuplicates(["_s", "_h"])
    one = once.select("_k", "_s", F.posexplode("_len").alias("_m", "_l"))
    hist = one.groupBy("_s", "_m", "_l").agg(F.count("*").alias("_n"))
    w = W.partitionBy("_s", "_m").orderBy("_l").rangeBetween(-AROUND, AROUND)
    around = (F.sum("_n").over(w) - F.col("_n")) / F.lit(2.0 * AROUND)
    spikes = hist.withColumn("_mean", around).where(_stands_out(F.col("_n"), F.col("_mean")))
    on = one.join(spikes, ["_s", "_m", "_l"])
    best = on.groupBy("_k").agg(F.max(F.struct("_n", -F.col("_m"), "_s", "_m", "_l", "_mean")).alias("_b"))
    names = F.array(*[F.lit(x) for x in METRICS])
    return (
        best.groupBy("_b._s", "_b._m", "_b._l")
        .agg(F.count("*").alias("texts"), F.max("_b._mean").alias("_mean"))
        .where(_stands_out(F.col("texts"), F.col("_mean")))
        .select("_s", "_m", "_l", names[F.col("_m")].alias("metric"), "texts")
    )


CLOSER = r"\\(end\{[A-Za-z]+\*?\}|bibliography\{[^{}\n]*\}|fi)$"


def _last_line(c: str) -> Column:
    return F.substring_index(F.col(c), "\n", -1)


def _line_is_apart(c: str) -> Column:
    """The last line stands apart from the text before it: marked as a comment or rule, or after an empty line, or all there is."""
    last, two = _last_line(c), F.substring_index(F.col(c), "\n", -2)
    marked = F.startswith(last, F.lit("%")) | F.startswith(last, F.lit("--"))
    all_there_is = F.octet_length(two) == F.octet_length(last)
    return marked | all_there_is | (F.rtrim(F.substring_index(two, "\n", 1), F.lit(" \t")) == "")


def _without_trailers() -> Column:
    """_end up to its last line that is neither empty nor one of _trailers."""
    lines = F.split("_end", "\n")
    stays = lambda line: (_trim_end(line) != "") & ~F.array_contains("_trailers", F.trim(_trim_end(line)))
    last = F.array_max(F.transform(lines, lambda line, i: F.when(stays(line), i + 1).otherwise(0)))
    return _trim_end(F.array_join(F.slice(lines, 1, last), "\n"))


def _ends_whole() -> Column:
    """The ending closes a unit: an environment, a sentence, a display formula, a reference, an include.

    Over the columns _end, _line (its last line), _para (its last paragraph) and _odd (unclosed braces or formula
    in the paragraph), which are made beforehand so that none is computed twice.
    """
    e, line, whole = F.col("_end"), F.col("_line"), ~F.col("_odd")
    closer = line.rlike(CLOSER) | line.rlike(r"\\(input|include)\{[^{}]*\}$")
    sentence = line.rlike(r"[.!?…][)\]}'\"»”]*$") & ~line.rlike(r"\.\.\.$|…$|^\s*\\bibitem") & whole
    formula = line.rlike(r"\\\]$|\$\$$")
    reference = line.rlike(r"^\s*\[\d+\] .*\b\d{4}\.?$")
    command = line.rlike(r"^\s*\\(caption|title|author|section\*?|subsection\*?|label|footnote|emph)\{.*\}$") & whole
    return (e == "") | closer | sentence | formula | reference | command


def _with_ending_parts(df: DataFrame) -> DataFrame:
    # from the last empty line on, and in it from the last line of blanks on: the rest of the text is not searched
    block = F.concat(F.lit("\n"), F.substring_index(F.col("_end"), "\n\n", -1))
    x = df.withColumn("_line", _last_line("_end")).withColumn("_para", F.substring_index(F.regexp_replace(block, r"\n[ \t]+\n", "\n\n"), "\n\n", -1))
    dollars = _count(F.replace(F.col("_para"), F.lit("\\$")), "$")
    return x.withColumn("_odd", (_count(F.col("_para"), "{") > _count(F.col("_para"), "}")) | (dollars % 2 != 0))


def cut_texts(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per text: key, source, cut, reason ('limit', 'ending'), metric and limit (for 'limit').

    A text is cut if it lies on one of its source's storage limits and does not end with a closed final unit, or
    if its ending, without appended trailers, breaks off inside a unit. Trailers are last lines apart from
    the text that recur over the texts of the source or of all sources; they are found from all texts that lie
    on no limit. Empty and null texts are not cut; a null source is a source of its own.

    The whole texts are read once; they and their lengths are written to the shared folder and serve the
    histograms, the trailers and the decision. Findings per source are small (broadcast only up to 1000
    sources, else joined by shuffle).
    """
    f = written(text_features(docs, key, text, source).withColumn("_s", F.coalesce(F.col("_s").cast("string"), F.lit("\x00"))), "endings")
    limits = written(storage_limits(f), "limits")
    per_limits = limits.groupBy("_s").agg(F.collect_list(F.struct("_m", "_l", "metric", "texts")).alias("_limits"))
    sources = f.groupBy("_s").agg(F.count("*").alias("_docs"))
    per = written(sources.join(per_limits, "_s", "left"), "sources")
    few = per.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    side = lambda d: F.broadcast(d) if few else d
    hit = F.filter("_limits", lambda x: F.element_at("_len", x["_m"] + 1) == x["_l"])
    at = f.join(side(per), "_s").withColumn("_hit", F.element_at(F.when(F.size(hit) > 0, hit), 1))

    # trailers, of texts on no limit
    total = sources.agg(F.sum("_docs")).first()[0] or 0
    tail = at.where(F.col("_hit").isNull() & (F.col("_tail") != "")).select("_s", "_docs", F.col("_tail").alias("_line"))
    # a last line may be a text of its own: hashes are counted, and only lines that recur are fetched
    marks = written(tail.groupBy(F.sha2("_line", 256).alias("_hash"), "_s").agg(F.count("*").alias("_n"), F.max("_docs").alias("_docs")), "marks")
    often = marks.groupBy("_hash").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= LEAST_TRAILERS)
    lines = marks.join(often, "_hash")
    lines = lines.where(((F.col("_n") >= LEAST_TRAILERS) & (F.col("_n") >= TRAILER_SHARE * F.col("_docs"))) | (F.col("_all") >= TRAILER_SHARE_ALL * total))
    lines = written(lines, "recurring")
    text = tail.select(F.sha2("_line", 256).alias("_hash"), "_line").join(small(lines.select("_hash").distinct()), "_hash").groupBy("_hash").agg(F.min("_line").alias("_line"))
    lines = written(lines.join(text, "_hash"), "lines")
    own = (F.col("_n") >= LEAST_TRAILERS) & (F.col("_n") >= TRAILER_SHARE * F.col("_docs"))
    common = F.col("_all") >= TRAILER_SHARE_ALL * total
    # lines common to all texts count everywhere; at most 1 / share of them can exist
    general = lines.where(common).select("_line").distinct().agg(F.collect_set("_line").alias("_lines")).first()[0]
    per_lines = lines.where(own).groupBy("_s").agg(F.collect_set("_line").alias("_own"))
    x = at.join(side(per_lines), "_s", "left").withColumn(
        "_trailers", F.array_union(F.coalesce("_own", F.array().cast("array<string>")), F.array(*[F.lit(s) for s in sorted(general)]).cast("array<string>"))
    )
    x = x.withColumn("_end", F.when(F.array_contains("_trailers", F.trim(_last_line("_end"))), _without_trailers()).otherwise(F.col("_end")))
    final = _last_line("_end").rlike(r"\\end\{(document|thebibliography)\}$|\\bibliography\{[^{}\n]*\}$")
    by_limit = F.col("_hit").isNotNull() & ~final
    x = _with_ending_parts(x)
    by_end = ~_ends_whole()
    cut = (F.element_at("_len", 1) > 0) & (by_limit | by_end)
    decided = x.select(
        F.col("_k").alias(key), F.when(F.col("_s") != "\x00", F.col("_s")).alias(source), cut.alias("cut"),
        F.when(cut, F.when(by_limit, "limit").otherwise("ending")).alias("reason"),
        F.when(cut & by_limit, F.col("_hit.metric")).alias("metric"), F.when(cut & by_limit, F.col("_hit._l")).alias("limit"),
    )
    # written, as a filter on `cut` would otherwise be pushed below every step, each step's expression copied into it
    return written(decided, "cut")


def cut_shares(cut: DataFrame, source: str) -> DataFrame:
    """Per source: texts, cut texts, their share, and how many of them lie on a storage limit."""
    return cut.groupBy(source).agg(
        F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if(F.col("reason") == "limit").alias("at_limit"),
        F.avg(F.col("cut").cast("double")).alias("cut_share"),
    )
