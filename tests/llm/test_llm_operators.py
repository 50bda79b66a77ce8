import base64
import datetime as dt
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import nearest, overlap, quantiles, spam, tokenize
from tidegauge.llm.mixing import Mixture, rake
from tidegauge.llm.nearest import XFastTrie, nearest_in_time

PATH = os.path.join(tokenize.TOKENIZERS, tokenize.VOCABULARY)
LOG = "record_no bigint, method_id string, stage_name string, wall_time_s double, recorded_at timestamp, ingested_at timestamp, v string, day string"
DAY = dt.datetime(2024, 1, 1)


# Percentiles


def log_rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["m1", "m1", "m1", "m2", None]), rng.choice(["A", "b"]), rng.choice([round(rng.lognormvariate(0, 2), 3), 0.0, 1.0]), DAY + dt.timedelta(days=rng.randrange(3)), DAY, "x", "y") for i in range(n)]


def test_percentiles_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GATHER", 3)
    rows = log_rows(3000)
    rows += rows[:100] + [(9001, "m1", "a", None, DAY, DAY, "", ""), (9002, "m1", "a", float("nan"), DAY, DAY, "", ""), (9003, "m1", "a", -1.0, DAY, DAY, "", ""), (9004, "solo", "a", 7.0, None, None, "", "")]
    got = {(r.scope, r.method_id, r.stage_name): r for r in quantiles.percentiles(quantiles.day_lists(spark.createDataFrame(rows, LOG))).collect()}
    once = {r[0]: r for r in rows if r[3] is not None and r[3] == r[3] and r[3] >= 0}
    groups = {("all", None, None): [r[3] for r in once.values()]}
    for r in once.values():
        if r[1]:
            groups.setdefault(("group", r[1], r[2].lower()), []).append(r[3])
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = sorted(v)
        want = [v[(p * len(v) + 999) // 1000 - 1] for p in quantiles.PERMILLE]
        assert [got[k][c] for c in ("p50", "p90", "p95", "p99", "p999")] == want and got[k].n == len(v) and got[k].rank_error == 0


def test_pivot_rounds_to_the_end_over_many_groups_days_and_lists(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GATHER", 0)
    monkeypatch.setattr(quantiles, "LIST_ROWS", 40)
    monkeypatch.setattr(quantiles, "LEAVES", 2)
    rng = random.Random(3)
    rows = [(i if i % 9 else None, f"m{min(7, int(rng.expovariate(0.5)))}", rng.choice("abc"), float(rng.choice([rng.randrange(40), rng.randrange(10**6)])), DAY + dt.timedelta(days=rng.randrange(9)), DAY, "", "") for i in range(2500)]
    got = {(r.method_id, r.stage_name): r for r in quantiles.percentiles(quantiles.day_lists(spark.createDataFrame(rows, LOG)), (500, 999)).collect()}
    groups = {(None, None): sorted(r[3] for r in rows)}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r[3])
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = sorted(v)
        assert (got[k].n, got[k].p50, got[k].p999) == (len(v), v[(500 * len(v) + 999) // 1000 - 1], v[(999 * len(v) + 999) // 1000 - 1])


def test_days_computed_apart_join_to_the_same(spark):
    df = spark.createDataFrame(log_rows(1500, 4), LOG)
    whole = {tuple(r) for r in quantiles.percentiles(quantiles.day_lists(df)).collect()}
    parts = [quantiles.day_lists(df.filter(f"to_date(recorded_at) = date'2024-01-0{i}'")) for i in (1, 2, 3)]
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert {tuple(r) for r in quantiles.percentiles(joined).collect()} == whole


def test_percentiles_of_nothing(spark):
    rows = quantiles.percentiles(quantiles.day_lists(spark.createDataFrame([], LOG))).collect()
    assert [(r.scope, r.n, r.p50) for r in rows] == [("all", 0, None)]


# Overlaps across splits

SCEN = "fault_id string, root_cause_service string, fault_type string, causal_path array<array<string>>, split string, source_set string, edges string, words int"


def test_overlaps_against_brute_force(spark):
    rng = random.Random(2)
    nodes = "abcdefg"
    rows = []
    for i in range(220):
        path = [list(rng.sample(nodes, 2)) for _ in range(rng.randrange(0, 5))]
        rows.append((f"f{i}", rng.choice(["R_x", "r-x ", "q", None]), rng.choice(["LAG", "lag", None]), path or None, rng.choice(["DEVELOPMENT", "development ", "VALIDATION", "held-out test", None]), "s", "clash", 1))
    rows += rows[:20] + [("n1", "q", "LAG", [[None, "a"], ["a"], []], "VALIDATION", "s", "", 1)]
    got = {(r.training_id, r.other_id, r.kind) for r in overlap.cross_split_overlaps(spark.createDataFrame(rows, SCEN)).collect()}

    def plain(x):
        return x and x.strip().lower().replace("_", "-").replace(" ", "-")

    seen = {r[0]: (plain(r[1]), plain(r[2]), plain(r[4]), {tuple(e) for e in r[3]}) for r in rows[:220] if r[1] and r[2] and r[3] and r[4]}
    want = set()
    for a, (ra, fa, sa, ea) in seen.items():
        for b, (rb, fb, sb, eb) in seen.items():
            if sa == "development" != sb and (ra, fa) == (rb, fb) and len(ea - eb) <= 1 and len(eb - ea) <= 1:
                want.add((a, b, "exact" if ea == eb else "near"))
    assert got == want and {k for _, _, k in want} == {"exact", "near"}
    assert overlap.cross_split_overlaps(spark.createDataFrame([], SCEN)).count() == 0
    assert overlap.overlap_report(spark.createDataFrame(rows, SCEN)).count() == 2


# Nearest in time


@given(st.lists(st.integers(0, 1023), max_size=40), st.lists(st.integers(0, 1023), min_size=1, max_size=40))
def test_trie_neighbours(keys, queries):
    trie = XFastTrie(np.array(keys, np.int64), 10)
    before, after = trie.neighbours(np.array(queries, np.int64))
    for q, b, a in zip(queries, before, after, strict=True):
        assert (trie.keys[b] if b >= 0 else None) == max((k for k in keys if k <= q), default=None)
        assert (trie.keys[a] if a >= 0 else None) == min((k for k in keys if k >= q), default=None)


@pytest.mark.parametrize("bits", [4, 21])
def test_nearest_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(nearest, "BLOCK_BITS", bits)
    rng = random.Random(5)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400, 3)]), i, "clash") for i in range(150)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(1, 400, 7)]), i, "clash") for i in range(60)]
    got = {(r.lid, r.rid, r.distance_ms) for r in nearest_in_time(spark.createDataFrame(left, "e string, t bigint, lid int, row string"), spark.createDataFrame(right, "e string, t bigint, rid int, row string"), entity="e", left_time="t", right_time="t", left_id=["lid"], right_id=["rid"], tolerance_ms=9).collect()}
    want = set()
    for e, t, i, _ in left:
        near = sorted((abs(t - u), u, str({"c0": j}).replace("'", '"').replace(" ", ""), j) for f, u, j, _ in right if e and e == f and t is not None and u is not None and abs(t - u) <= 9) if t is not None else []
        if near:
            want.add((i, near[0][3], near[0][0]))
    assert got == want
    none = spark.createDataFrame([], "e string, t bigint, rid int, row string")
    assert nearest_in_time(spark.createDataFrame(left, "e string, t bigint, lid int, row string"), none, entity="e", left_time="t", right_time="t", left_id=["lid"], right_id=["rid"], tolerance_ms=9).count() == 0


def test_of_equal_times_the_least_id_as_a_number(spark):
    left = spark.createDataFrame([("a", 100, 1), ("a", 100, 1), ("a", 112, 2)], "e string, t bigint, lid int")
    right = spark.createDataFrame([("a", 105, 10), ("a", 105, 9), ("a", 119, 3), ("a", None, 1), (None, 100, 1)], "e string, t bigint, rid int")
    got = nearest_in_time(left, right, entity="e", left_time="t", right_time="t", left_id=["lid"], right_id=["rid"], tolerance_ms=9)
    assert sorted(map(tuple, got.collect())) == [(1, 9, 5), (1, 9, 5), (2, 9, 7)]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 63)), max_size=30), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 63)), min_size=1, max_size=30))
def test_tries_of_many_groups(keys, queries):
    trie = XFastTrie(np.array([g << 6 | k for g, k in keys], np.int64), 6)
    before, after = trie.neighbours(np.array([g << 6 | q for g, q in queries], np.int64))
    for (g, q), b, a in zip(queries, before, after, strict=True):
        own = [k for h, k in keys if h == g]
        assert (trie.keys[b] & 63 if b >= 0 else None) == max((k for k in own if k <= q), default=None)
        assert (trie.keys[a] & 63 if a >= 0 else None) == min((k for k in own if k >= q), default=None)


# Encoding

TEXTS = [None, "", " ", "  \n\t ", "It's we'll 'sx  a\n\n b　c\x85d\x1ce", "²٠ ½x 😀👩‍👩‍👧 ẞ", "<|endoftext|>", "a" * 40_000, "the water board " * 3000, "\x00﻿", "Ünïcode—dash… «q»"]


def reference(texts):
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [enc.encode_ordinary(t) if t else [] for t in texts]


def test_ids_equal_the_library_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "TABLE_WORDS", 3)
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], 2, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, word string")
    got = tokenize.encode_corpus(df, keep=["doc_id"]).collect()
    want = reference(TEXTS)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted([(i, tuple(x)) for i, x in enumerate(want)] + [(3, tuple(want[4]))])
    tokens = tokenize._tokens(PATH)
    assert all(b"".join(tokens[i] for i in r.ids).decode() == TEXTS[r.doc_id] for r in got if r.doc_id > 4)
    n = {(r.doc_id, r.n_tokens) for r in tokenize.encode_corpus(df, keep=["doc_id"], lengths=True).collect()}
    assert n == {(r.doc_id, len(r.ids)) for r in got}
    assert tokenize.encode_corpus(df.limit(0), keep=["doc_id"]).count() == 0


@settings(max_examples=60)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_replay_of_any_text(texts):
    words = [w for t in texts for w in tokenize.coarse_words(t)]
    assert "".join(words) == "".join(texts)
    ids = dict(zip(words, tokenize.merge_replay(words, PATH), strict=True))
    got = [[i for w in tokenize.coarse_words(t) for i in np.frombuffer(ids[w], "<i4").tolist()] for t in texts]
    assert got == reference(texts)


# Mixing

DOCS = "doc_id bigint, text string, lang string, source string, agenda_item string, copies int, weight double"
MIX = "mix_id int, size_ratio double, source string, target_share double, max_repeats int"


def test_shares_caps_and_unreachable_targets(spark):
    rng = random.Random(1)
    sizes = {"a": 300, "b": 60, "c": 10}
    docs = [(i, "word " * rng.randrange(3, 60), rng.choice(["en", "de", None]), rng.choice([s, s.upper() + " "]), f"{i % 7} topic {i % 5}", 1, 1.0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs += [(900, None, "en", "a", None, 1, 1.0), (901, "", None, "a", None, 1, 1.0), (902, "no source", "en", None, None, 1, 1.0), (903, "unlisted", "en", "z", None, 1, 1.0)]
    targets = [(1, 0.5, "A", 0.6, 1), (1, 0.5, "b", 0.3, 3), (1, 0.5, "c", 0.1, 2), (2, 1.0, "a", 0.5, 1), (2, 1.0, "c", 0.4, 2), (2, 1.0, "none", 0.1, 5), (3, 1.0, None, 0.5, 1), (3, None, "a", 0.5, 1)]
    m = Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, MIX))
    rep = {(r.mix_id, r.source): r for r in m.report().collect()}
    assert set(rep) == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c"), (2, "none")}
    for r in rep.values():
        assert r.most_copies <= r.max_repeats
        if r.reachable and r.target_tokens:
            assert abs(r.actual_tokens - r.target_tokens) <= max(130, 0.03 * r.target_tokens)
    assert rep[2, "c"].actual_tokens == 2 * rep[2, "c"].available_tokens and not rep[2, "c"].reachable
    assert rep[2, "none"].actual_tokens == 0 and not rep[2, "none"].reachable
    drawn = m.copies.collect()
    assert all(r.doc_id < 900 and r.n_tokens > 0 for r in drawn) and len({(r.mix_id, r.doc_id) for r in drawn}) == len(drawn)


def test_raking_meets_the_marginals():
    import pandas as pd

    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(s, lang, t, float(rng.integers(50, 500))) for s in "ab" for lang in ("en", "de") for t in range(3)], columns=["source", "lang", "topic", "tokens"])
    cells["goal"], cells["max_repeats"] = cells["source"].map({"a": 700.0, "b": 900.0}), 5
    w, residual = rake(cells)
    got = (w * cells["tokens"]).groupby(cells["source"]).sum()
    assert got["a"] == pytest.approx(700) and got["b"] == pytest.approx(900) and w.between(0, 5).all()
    lang = (w * cells["tokens"]).groupby(cells["lang"]).sum() / 1600
    assert lang["en"] == pytest.approx(cells.loc[cells.lang == "en", "tokens"].sum() / cells["tokens"].sum(), abs=1e-6)
    assert residual < 1e-5


def test_what_raking_cannot_meet_is_reported():
    import pandas as pd

    # Language en is in source a only, whose goal is small: its marginal is out of reach.
    cells = pd.DataFrame([("a", "en", "x", 500.0, 10.0, 5), ("b", "de", "x", 500.0, 900.0, 5)], columns=["source", "lang", "topic", "tokens", "goal", "max_repeats"])
    w, residual = rake(cells)
    assert (w * cells["tokens"]).tolist() == pytest.approx([10.0, 900.0]) and residual == pytest.approx((455 - 10) / 910)


def test_topics_of_a_small_share_are_raked_as_one(spark):
    from tidegauge.llm.mixing import LEAST_SHARE, OTHER, _classes

    rows = [("big", 10_000), ("mid", 100), ("tiny", int(10_000 * LEAST_SHARE) - 2), ("none", 0)]
    got = {r.n_tokens: r.topic for r in _classes(spark.createDataFrame(rows, "topic string, n_tokens bigint"), "topic").collect()}
    assert got == {10_000: "big", 100: "mid", int(10_000 * LEAST_SHARE) - 2: OTHER, 0: OTHER}


def test_empty_mix(spark):
    m = Mixture(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 0.5, "a", 1.0, 1)], MIX))
    assert m.copies.count() == 0 and [r.actual_tokens for r in m.report().collect()] == [0]


# Spam

SPAM = {
    1: "buy cheap watch strap, watch strap online, best watch strap, watch strap deal, " * 12,
    2: "\n".join(f"* [winter boots {i}](http://shop{i}.example/p/{i})" for i in range(40)),
    3: "Looking for garden hose? Our garden hose is the garden hose that every garden hose buyer wants. If you like garden hose, you will love garden hose, the only garden hose made for garden hose lovers. " * 4,
}
HAM = {
    11: "Ayes (4): Lorin Vask (HL); T. Holm (NC); Quira Fen (LL); Ana Bel (GA); U. Mar (CU); Selka Dorn (HL); B. Stein (NC); Edra Kol (GA)",
    12: "Lorton | 159 | 992 | 5.0 %\nHolmere | 940 | 947 | 21.2 %\nKelgate | 416 | 835 | 55.1 %\nGalfa | 716 | 300 | 39.8 %\n" * 3,
    13: "The ayes have it, the ayes have it.\nThe House divided: Ayes 523, Noes 258.\nThe ayes have it, the ayes have it.\nThe question is that the motion be agreed to. Are we all agreed?\n" * 3,
    14: "Order of business\n" + "\n".join(f"{i}. The water board - {i} min." for i in range(1, 14)),
    15: "a" * 20_000,
    16: "   \n ",
    17: "",
    18: None,
    19: "I rise to support the motion. A farmer asked me whether the school fund would still exist next year, and I had no answer. He read me a notice: “watch strap sale, watch strap sale, watch strap sale, watch strap sale”. I ask the government to publish the letters (see https://records.example/annex/2). We have heard the minister; we have not heard the figures.",
}


def corpus():
    rng = random.Random(0)
    subjects = ["the water board", "the flood defences", "the public archive", "the rural clinics", "the postal contract", "the school fund"]
    verbs = ["deserves a proper inquiry", "was promised to every district", "will cost more than the minister admits", "cannot wait for another winter", "needs a clear timetable", "has been postponed twice"]
    out = []
    for i in range(400):
        text = " ".join(f"In {rng.choice('March April May June'.split())} the inspectors counted {rng.randrange(999)} cases, and {rng.choice(subjects)} {rng.choice(verbs)}." for _ in range(rng.randrange(4, 14)))
        out.append((100 + i, text, rng.choice(["en", "en", None])))
    for i in range(40):
        out.append((600 + i, ", ".join(f"{rng.choice(['cheap', 'best', 'buy', 'online'])} {rng.choice(['watch strap', 'garden hose', 'desk lamp'])}" for _ in range(60)), "en"))
    return out


def test_spam_and_what_looks_like_it(spark):
    rows = [(*r, "clash", 0.0) for r in corpus()] + [(i, t, "en", "clash", 0.0) for i, t in (SPAM | HAM).items()] + [(1, SPAM[1], "en", "again", 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, fold string, spam_share double")
    got = [r.doc_id for r in spam.spam_documents(df).collect()]
    assert set(got) == set(SPAM) | set(range(600, 640)) and got.count(1) == 2
    assert spam.spam_shares(df).count() == len(rows)


def test_spam_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert spam.spam_shares(df).count() == 0
    assert [r.spam_share for r in spam.spam_shares(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, lang string")).collect()] == [0.0]


@given(st.text(max_size=3000))
def test_blocks_hold_the_whole_text(text):
    assert "".join("".join(spam.blocks_of(text)).split()) == "".join(text.split())
