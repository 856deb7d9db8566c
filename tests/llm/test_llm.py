"""The llm operators against brute force, round trips and planted cases."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelmill.llm.mixing import _thresholds, mix, poisson_cdf
from panelmill.llm.packing import _Sums, pack, pack_histogram
from panelmill.llm.tokens import VOCABULARY, count_tokens, encoding, with_token_counts
from panelmill.llm.topn import _scan, row_group_stats, top_n, write_clustered
from panelmill.llm.truncation import METRICS, cut_shares, cut_texts, text_features
from panelmill.session import table_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- top n


def brute_top(data, n):
    best = {}
    for g, i, s in data:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(s, best.get((g, i), s))
    out = []
    for g in {g for g, _ in best}:
        mine = sorted(((-s, i) for (gg, i), s in best.items() if gg == g))[:n]
        out += [(g, i, -s, k + 1) for k, (s, i) in enumerate(mine)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1000, 256 * 1024, 64 << 20])
def test_top_n_with_a_hot_group_ties_copies_and_nulls(spark, block):
    rng = np.random.default_rng(1)
    data = [("hot", int(i), float(rng.integers(0, 400))) for i in rng.integers(0, 5000, 8000)]
    data += [(f"g{k}", int(i), float(rng.integers(0, 5))) for k in range(300) for i in rng.integers(0, 30, 12)]
    data += [("small", 1, 2.0), ("small", 1, 5.0), ("small", 2, 5.0), ("nan", 1, float("nan")), ("nan", 2, None), (None, 1, 1.0), ("inf", 1, float("inf")), ("inf", None, 9.0)]
    df = spark.createDataFrame(data, "grp string, item int, score double").withColumn("g", F.lit("clash")).withColumn("place", F.lit(0))
    assert rows(top_n(df, "grp", "item", "score", 5, block)) == brute_top(data, 5)


def test_top_n_dates_and_empty(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, k), i, float(i)) for k in (1, 2) for i in range(9)], "date date, item int, score double")
    got = top_n(df, "date", "item", "score", 2)
    assert rows(got.select("date", "item")) == sorted([(dt.date(2024, 1, k), i) for k in (1, 2) for i in (7, 8)], key=str)
    assert top_n(df.limit(0), "date", "item", "score", 2).count() == 0


def test_top_n_keeps_the_type_of_the_score(spark):
    from decimal import Decimal

    big = [("g", i, 2**60 + i) for i in range(4)]
    got = top_n(spark.createDataFrame(big, "g string, i int, s long"), "g", "i", "s", 2)
    assert dict(got.dtypes)["s"] == "bigint" and rows(got) == [("g", 2, 2**60 + 2, 2), ("g", 3, 2**60 + 3, 1)]
    for kind, make in (
        ("decimal(30,10)", lambda k: Decimal(10) ** 15 + Decimal(k) / 10**9), ("decimal(12,2)", lambda k: Decimal(k) / 4), ("date", lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)),
        ("timestamp_ntz", lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k)), ("float", float), ("int", int), ("string", lambda k: f"{k:04d}"),
    ):
        data = [(f"g{k % 3}", k, make(k)) for k in range(40)]
        got = top_n(spark.createDataFrame(data, f"g string, i int, s {kind}"), "g", "i", "s", 2)
        assert rows(got.select("g", "i", "place")) == [("g0", 36, 2), ("g0", 39, 1), ("g1", 34, 2), ("g1", 37, 1), ("g2", 35, 2), ("g2", 38, 1)], kind


def test_row_groups_are_skipped(spark):
    import pyarrow.parquet as pq

    path = table_path(spark, "test")
    df = spark.range(60_000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("i"), F.rand(3).alias("s"))
    write_clustered(df, "g", "i", "s", path, 16 * 1024)
    stats = row_group_stats(spark, path).collect()
    assert len(stats) > 12 and sum(r["n"] for r in stats) == 60_000 and all(r["s_lo"] <= r["s_hi"] for r in stats)
    read, total = [0], 0
    for p in {r["path"] for r in stats}:
        mine = sorted((r for r in stats if r["path"] == p), key=lambda r: -r["s_hi"])
        total += len(mine)
        _scan(pq.ParquetFile(p.removeprefix("file://")), [r["rg"] for r in mine], [r["s_hi"] for r in mine], [r["g_lo"] == r["g_hi"] for r in mine], 5, read)
    assert read[0] < total / 2


# ---- tokens


def test_token_counts_whole_null_empty_long(spark):
    enc = encoding(VOCABULARY)
    texts = ["", None, "Hello  world\n\n  of\ttokens <|endoftext|>", "naïve Ünïcode 漢字 🎉", "\n" * 50 + "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("n_tokens", F.lit("clash"))
    assert rows(with_token_counts(df, "t", ["id"])) == [(i, len(enc.encode_ordinary(t)) if t else 0) for i, t in enumerate(texts)]


def test_long_texts_in_pieces_count_the_same(monkeypatch):
    enc = encoding(VOCABULARY)
    text = "\n".join(f"Line {i} of the text,  with  spaces.\n\n\tand more \n" for i in range(60))
    want = len(enc.encode_ordinary(text))
    for piece in (40, 97, 500):
        monkeypatch.setattr("panelmill.llm.tokens.PIECE", piece)
        assert count_tokens(text, enc) == want


# ---- packing


def check_packing(got, sizes, cap):
    """got: (piece, start, n, container) per key."""
    use = {}
    for key, n in sizes.items():
        pieces = sorted(got[key])
        assert sum(p[2] for p in pieces) == max(n or 0, 0) and (len(pieces) == 1) == ((n or 0) <= cap)
        at = 0
        for k, (piece, start, size, container) in enumerate(pieces):
            assert piece == k and start == at and size <= cap
            at += size
            use[container] = use.get(container, 0) + size
    assert max(use.values(), default=0) <= cap and sorted(use) == list(range(len(use)))
    return len(use)


def best_fit_decreasing(sizes, cap):
    """Containers of the usual heuristic, oversize items split as in pack()."""
    whole = sum((n or 0) // cap - ((n or 0) == cap) for n in sizes if (n or 0) >= cap)
    rest = sorted(((n if n <= cap else n % cap) for n in sizes if n), reverse=True)
    gaps = []
    for n in rest:
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        elif n:
            gaps.append(cap - n)
    return whole + len(gaps)


def packed(df, key, size, specs):
    out = {}
    for r in pack(df, key, size, specs).collect():
        out.setdefault(r["spec_id"], {}).setdefault(r[key], []).append((r["piece"], r["start"], r["n_tokens"], r["container"]))
    return out


def test_pack_every_item_once_and_nothing_split_that_fits(spark):
    rng = np.random.default_rng(4)
    sizes = {i: int(n) for i, n in enumerate(np.r_[rng.integers(1, 100, 600), np.full(300, 37), rng.integers(100, 950, 40), [100, 100, 200, 0, 0]])}
    sizes[9999] = None
    df = spark.createDataFrame(list(sizes.items()), "doc int, n int").withColumn("container", F.lit("clash"))
    got = packed(df, "doc", "n", [(1, 100), (2, 333)])
    for spec, cap in ((1, 100), (2, 333)):
        bins = check_packing(got[spec], sizes, cap)
        assert bins <= best_fit_decreasing(sizes.values(), cap)


def test_pack_empty_and_only_empty_items(spark):
    df = spark.createDataFrame([], "doc int, n int")
    assert pack(df, "doc", "n", [(1, 10)]).count() == 0
    got = packed(spark.createDataFrame([(1, 0), (2, None)], "doc int, n int"), "doc", "n", [(1, 10)])
    assert got == {1: {1: [(0, 0, 0, 0)], 2: [(0, 0, 0, 0)]}}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 60))
def test_histogram_packing_is_exact(lengths, cap):
    counts = np.bincount(lengths, minlength=cap + 1) if lengths else np.zeros(cap + 1, int)
    used, made = np.zeros(cap + 1, int), 0
    for many, items in pack_histogram(counts, cap):
        assert many > 0 and sum(items) <= cap
        np.add.at(used, list(items), many)
        made += many
    assert (used == counts).all() and made <= best_fit_decreasing(lengths, cap)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 25), min_size=1, max_size=40), st.data())
def test_pair_sums_are_kept_as_lengths_run_out(lengths, data):
    counts = np.bincount(lengths, minlength=26)
    sums = _Sums(counts)
    for _ in range(6):
        left = [k for k in range(26) if sums.n[k]]
        want = {a + b for a in left for b in left if a < b or (a == b and sums.n[a] > 1)}
        assert {s for s in range(len(sums.pairs)) if sums.pairs[s]} == want and (sums.pairs >= 0).all()
        for total in range(52):
            two = sums.pair(total)
            assert (two is not None) == (total in want) and (not two or sum(two) == total)
        if not left:
            break
        x = data.draw(st.sampled_from(left))
        sums.take(x, data.draw(st.integers(1, int(sums.n[x]))))


@pytest.mark.parametrize("cap,most", [(1024, 900), (2048, 2048), (8192, 3000)])
def test_no_worse_than_best_fit_decreasing(cap, most):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        sizes = np.minimum(rng.lognormal(np.log(cap / 4), 0.9, 1500).astype(int) + 1, most).tolist()
        made = sum(m for m, _ in pack_histogram(np.bincount(sizes, minlength=cap + 1), cap))
        assert -(-sum(sizes) // cap) <= made <= best_fit_decreasing(sizes, cap)


def test_ranks_in_many_parts_give_every_item_one_slot(spark, monkeypatch):
    monkeypatch.setattr("panelmill.llm.packing.PART", 50)
    sizes = {i: 10 if i % 3 else 7 + i % 5 for i in range(3000)}
    got = packed(spark.createDataFrame(list(sizes.items()), "doc int, n int"), "doc", "n", [(1, 64), (2, 9)])
    for spec, cap in ((1, 64), (2, 9)):
        assert check_packing(got[spec], sizes, cap) <= best_fit_decreasing(sizes.values(), cap)


def test_exact_complements_leave_no_gap():
    counts = np.zeros(101, int)
    for a, b, c, e in ((61, 20, 12, 7), (53, 31, 9, 7), (90, 10, 0, 0), (70, 18, 12, 0), (100, 0, 0, 0)):
        for x in (a, b, c, e):
            counts[x] += 5
    counts[0] = 0
    assert sum(m for m, _ in pack_histogram(counts, 100)) == 25


# ---- mixing


def docs(spark, n=6000):
    return spark.range(n).select(
        F.col("id").alias("doc"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").when(F.col("id") % 100 < 98, "c").otherwise("other").alias("src"),
        (F.col("id") % 7 * 10 + 5).cast("int").alias("n"), F.lit("clash").alias("copy"),
    )


TARGETS = [("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("gone", 0.1, 3)]


def test_mix_reaches_shares_and_keeps_caps(spark):
    m, r = mix(docs(spark), "doc", "src", "n", TARGETS)
    got = {x["source"]: x for x in r.collect()}
    assert got["gone"]["tokens"] == 0 and got["gone"]["reached_share"] == 0
    for s in "abc":
        assert got[s]["reached_share"] == pytest.approx(1 / 3, abs=0.002) and got[s]["most_copies"] <= got[s]["max_repeats"]
    per = m.groupBy("src").agg(F.sum("n").alias("n"), F.max("copy").alias("c"), F.count_distinct("doc", "copy").alias("d"), F.count("*").alias("k")).collect()
    assert {x["src"]: x["n"] for x in per} == {s: got[s]["tokens"] for s in "abc"} and all(x["d"] == x["k"] for x in per)
    keys = [x["shuffle_key"] for x in m.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert rows(mix(docs(spark), "doc", "src", "n", TARGETS)[0]) == rows(m)  # the same on every run


def test_mix_to_a_total(spark):
    _, r = mix(docs(spark), "doc", "src", "n", [("a", 0.5, 3), ("b", 0.5, 3)], total=50_000)
    assert [x["tokens"] for x in r.orderBy("source").collect()] == pytest.approx([25_000, 25_000], rel=0.02)


def test_mix_reports_a_total_that_cannot_be_had(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(20)], "doc int, src string, n int")
    with pytest.warns(UserWarning, match="200 is the most"):
        _, r = mix(df, "doc", "src", "n", [("a", 0.5, 1), ("b", 0.5, 1)], total=1000)
    assert {(x["total_asked"], x["total_reached"], x["asked_tokens"], x["tokens"]) for x in r.collect()} == {(1000.0, 200, 500.0, 100)}


@pytest.mark.parametrize("repeats", [3, 600, 5000])
def test_rates_of_any_size_reach_the_target(repeats):
    cells = np.ones(4096)
    for part in (0.2, 0.7, 0.999):
        t = np.array(_thresholds(cells, repeats, part * repeats * 4096))
        u = (np.arange(4096) + 0.5) / 4096
        n = (t[None, :] < u[:, None]).sum(1)
        assert n.mean() == pytest.approx(part * repeats, rel=0.01) and n.max() <= repeats


def test_mix_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None), (4, "a", 0)], "doc int, src string, n int")
    m, r = mix(df, "doc", "src", "n", [("a", 1.0, 2)])
    assert rows(m.select("doc", "copy")) == [(1, 1), (1, 2)] and r.first()["reached_share"] == 1.0
    m, r = mix(df.limit(0), "doc", "src", "n", TARGETS)
    assert m.count() == 0 and {x["reached_share"] for x in r.collect()} == {0.0}


def test_counts_follow_the_poisson_inverse():
    u = (np.arange(200_000) + 0.5) / 200_000
    cells = np.histogram(u, 4096, (0, 1))[0].astype(float)
    for target in (0.2, 0.9, 1.7, 2.6):
        t = _thresholds(cells, 3, target * cells.sum())
        n = sum((u > c).astype(int) for c in t)
        assert n.mean() == pytest.approx(target, abs=1e-3) and n.max() <= 3
    assert poisson_cdf(1.0, 2) == pytest.approx([np.exp(-1), 2 * np.exp(-1)])
    assert _thresholds(cells, 3, 3 * cells.sum()) == [-1.0] * 3


# ---- cut texts


def sentence(rng, n=12):
    words = ["lattice", "operator", "größe", "flux", "a<b", "mesh & grid", "kernel", "estimator", "colony"]
    return " ".join(rng.choice(words, n)).capitalize() + "."


def article(rng, lines):
    return "\\documentclass{article}\n\\begin{document}\n" + "\n\n".join(sentence(rng) for _ in range(lines)) + "\n\n\\end{document}\n"


def test_lengths_match_python(spark):
    import html
    import json

    texts = ["plain", 'a<b & "c" \'d\'', "größe\r\n漢字 🎉\n\ttab\\", "\r\n\r\n", "x\ry"]
    got = text_features(spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("s", F.lit("x")), "id", "t", "s").orderBy("_k").collect()
    for r, t in zip(got, texts):
        have = dict(zip(METRICS, r["_len"]))
        crlf = t.replace("\r\n", "\n").replace("\n", "\r\n")
        quoted = html.escape(t, quote=True).replace("&#x27;", "&#39;")
        js, asc = json.dumps(t, ensure_ascii=False)[1:-1], json.dumps(t)[1:-1]
        want = {
            "chars": len(t), "utf8": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2, "html_chars": len(html.escape(t, False)), "html_utf8": len(html.escape(t, False).encode()),
            "html_quoted_chars": len(quoted), "html_quoted_utf8": len(quoted.encode()), "json_chars": len(js), "json_utf8": len(js.encode()), "json_ascii": len(asc),
            "crlf_chars": len(crlf), "crlf_utf8": len(crlf.encode()), "lf_chars": len(t.replace("\r\n", "\n")), "lf_utf8": len(t.replace("\r\n", "\n").encode()),
        }
        assert have == want


def escaped(t):
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def cut_escaped(t, limit):
    """The longest start of t whose escaped form fits the limit exactly."""
    for k in range(len(t)):
        if len(escaped(t[:k])) == limit:
            return t[:k]
    return None


def test_planted_cuts(spark):
    rng = np.random.default_rng(8)
    data, want = [], set()

    def add(source, text, cut):
        data.append((len(data), source, text))
        if cut:
            want.add(len(data) - 1)

    for k in range(150):
        add("whole", article(rng, int(rng.integers(3, 30))), False)
        t = article(rng, int(rng.integers(3, 30)))
        add("chars", t[:1200], len(t) > 1200)
        t = article(rng, int(rng.integers(3, 30)))
        c = cut_escaped(t, 1500) if len(escaped(t)) > 1500 else None
        add("hidden", c if c else t if len(escaped(t)) <= 1500 else article(rng, 3), c is not None)
        body = "\n\n".join(sentence(rng) for _ in range(8))
        add("tails", body + "\n\n-- sent from the archive --", False)
        add("comments", body + "\n%% exported", False)
    for k in range(6):
        add("whole", article(rng, 20)[: 700 + 37 * k + k * k], True)  # mid-transfer
        body = "\n\n".join(sentence(rng) for _ in range(8))
        add("comments", body[: 300 + 13 * k].rstrip(" .") + "\n%% exported", True)
    add("whole", "", False)
    add("whole", None, False)
    add(None, "A sentence that is whole.", False)
    add(None, "A sentence that is n", True)
    df = spark.createDataFrame(data, "doc int, src string, t string").withColumn("cut", F.lit("clash"))
    out = cut_texts(df, "doc", "t", "src")
    got = {r["doc"]: r for r in out.collect()}
    assert len(got) == len(data)
    found = {k for k, r in got.items() if r["cut"]}
    # a sentence that happens to end where a mid-transfer cut falls can't be told apart
    assert len(found ^ want) <= 2
    hidden = [r for r in got.values() if r["src"] == "hidden" and r["reason"] == "limit"]
    assert hidden and {(r["metric"], r["limit"]) for r in hidden} == {("html_chars", 1500)}
    shares = {r["src"]: r for r in cut_shares(out, "src").collect()}
    assert shares["tails"]["cut_texts"] == 0 and shares["chars"]["texts"] == 150 and shares["chars"]["at_limit"] > 50


def test_cut_texts_on_empty_input(spark):
    df = spark.createDataFrame([], "doc int, src string, t string")
    assert cut_texts(df, "doc", "t", "src").count() == 0
