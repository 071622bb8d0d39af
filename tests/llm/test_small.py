"""The corpus operators on hand-made rows, against plain Python versions."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelchron.llm import exact_dedup as exact_dedup_module
from pixelchron.llm import lm_scoring, near_dedup
from pixelchron.llm._common import Scratch
from pixelchron.llm.bpe import ByteBPE, _bpe, encode_documents, encoded, token_digests
from pixelchron.llm.exact_dedup import drop_copies, exact_dedup
from pixelchron.llm.lm_scoring import CLASSES, GROUPS, SINGLES, MaxEnt, score_documents, squeezed, unsqueezed
from pixelchron.llm.mixing import mix, source_targets
from pixelchron.llm.near_dedup import near_duplicates
from pixelchron.llm.quality_classifier import classify_quality, isotonic, keep_quality, text_statistics
from pixelchron.llm.quality_rules import RULES, apply_rules, greedy, order_rules
from pixelchron.llm.secret_scan import learn_language, scan_secrets
from pixelchron.llm.sharding import shard_documents, smallest_capacity
from pixelchron.llm.token_files import Encoder, read_token_files, write_token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
rng = np.random.default_rng(3)
VOCABULARY = ["alpha", "beta", "Gamma", "délta", "日本", "the", "of", "and", "x1", "don't", "1234", "!!", "end."]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY, n))


BASE = " ".join(f"w{i}" for i in range(200))
#: Nulls, empty and very long texts, ties, repeated rows, near and exact copies.
TEXTS = [None, "", " \t\n", "a b c", "abc", "a  b\tc", "abc", prose(3), prose(40), prose(40), prose(4000), "word " * 300, "!" * 20, "line one two three\n" * 8, BASE, BASE.replace("w100", "changed"), BASE.replace("w5", "other").replace("w150", "more"), BASE + " tail", "A" * 5000, "Ünïcode ﬀ İ 🎉 \x1c \x85   x", "<|endoftext|> and <|endoftext|>"]
ROWS = [(i, t, ["a", None, "b"][i % 3]) for i, t in enumerate(TEXTS)] + [(3, "a b c", "a"), (None, "abc", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names operators might use themselves.
    return spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, source string, _size int, _key string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(autouse=True)
def _clean():
    yield
    Scratch.release_all()


def rows_of(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


def test_exact_dedup_equals_plain(docs, none):
    groups: dict[str, list] = {}
    for i, t, _ in ROWS:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    want = [[i, min(g)[3], len(g), min(g)[3] == i] for g in groups.values() for *_, i in g]
    assert rows_of(exact_dedup(docs, first_bytes=2), "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=repr)
    assert exact_dedup(none).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.filter("text is not null").select(F.regexp_replace("text", "[ \t\n]", "")).distinct().count() >= len(groups) - 1


def test_exact_dedup_takes_ids_of_any_order(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "MOST_BYTES", 5)
    rows = [("b", "x y"), ("a", "xy"), (None, "x  y"), ("c", "q" * 50), ("d", "q" * 50 + " "), ("e", "q" * 49)]
    got = rows_of(exact_dedup(spark.createDataFrame(rows, "doc_id string, text string"), first_bytes=2), "doc_id", "keep_id", "group_size")
    assert got == sorted([["b", None, 3], ["a", None, 3], [None, None, 3], ["c", "d", 2], ["d", "d", 2], ["e", "e", 1]], key=repr)
    least = -(1 << 63)
    got = exact_dedup(spark.createDataFrame([(least, "same"), (5, "same")], "doc_id long, text string"))
    assert {r["keep_id"] for r in got.collect()} == {least}


def test_sharding_is_minimax(spark, docs, none):
    got = [r.asDict() for r in shard_documents(docs, 3).collect()]
    assert len(got) == len(ROWS) and {r["law"] for r in got} == {"bytes"}
    groups: dict[str, int] = {}
    firsts: dict[str, tuple] = {}
    for i, t, _ in ROWS:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
        firsts[t or ""] = min(firsts.get(t or "", (1, 0)), (0, -1) if i is None else (0, i))
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    for s in set(loads):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by_text: dict[int, set] = {}
    for r in got:
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    assert {r["doc_id"]: r["text_crc32"] for r in got}[4] == zlib.crc32(b"abc")
    # Groups in order of their first id, cut so that the largest shard is as small as three shards allow; each shard is a run of groups.
    order = sorted(groups, key=firsts.get)
    sizes, upto = [groups[t] for t in order], np.cumsum([0, *(groups[t] for t in order)])
    best = min(max(upto[a], upto[b] - upto[a], upto[-1] - upto[b]) for a in range(len(sizes) + 1) for b in range(a, len(sizes) + 1))
    assert max(loads.values()) == best
    crc = {zlib.crc32(t.encode()): k for k, t in enumerate(order)}
    shards = [s for _, s in sorted({(crc[r["text_crc32"]], r["shard"]) for r in got})]
    assert shards == sorted(shards) and len(shards) == len(order)
    assert shard_documents(none, 3).count() == 0


@pytest.mark.parametrize("sizes", [[5], [1] * 10, [7, 1, 1, 9, 2, 2, 2, 6], [100, 1, 1, 1], rng.integers(1, 60, 80).tolist()])
def test_smallest_capacity_equals_dynamic_programme(spark, sizes):
    ends = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "end long").cache()
    capacity, cuts = smallest_capacity(ends, sum(sizes), max(sizes), 4)

    def fits(c):
        n, load = 1, 0
        for s in sizes:
            n, load = (n, load + s) if load + s <= c else (n + 1, s)
        return n <= 4

    assert capacity == next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c)) and len(cuts) == 4 and cuts[-1] == sum(sizes)


def test_mixing(docs, none):
    got = [r.asDict() for r in mix(docs).collect()]
    assert len(got) == len(ROWS) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
    for size, (target, taken) in by.items():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 4000
    assert sum(t for t, _ in by.values()) == pytest.approx(min(1.5 * total, 2 * total))
    assert rows_of(mix(docs.repartition(7)), "doc_id", "size", "taken") == rows_of(mix(docs), "doc_id", "size", "taken")
    assert mix(none).count() == 0


def test_targets_reshare_the_excess(spark):
    t = {r["_source"]: r["_target"] for r in source_targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 90)], "_source string, _total long")).collect()}
    assert t["a"] == 20 and t[None] == 180 and t["b"] == pytest.approx(1650 - 200)


def repeats(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)})


def test_quality_rules(docs, none):
    def plain(t):
        t = t or ""
        w = WORD.findall(t)
        full = [x for x in t.split("\n") if WORD.search(x)]
        nr = repeats(w)
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), nr, len(w) < 10 or 100 * nr > 20 * len(w)]

    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = apply_rules(docs).cache()
    assert rows_of(got, "doc_id", *columns) == sorted(([i, *plain(t)] for i, t, _ in ROWS), key=repr)
    assert got.filter("kept and base_failed").count() == 0 and got.filter("not base_failed and kept = (failed_rule is not null)").count() == 0
    order = order_rules(docs, RULES)
    assert sorted(n for n, _, _ in order) == sorted(RULES) and all(c > 0 and 0 <= s <= 1 for _, c, s in order)
    names = [n for n, _, _ in order]
    # Any order, also one of ties, gives the same verdicts.
    assert rows_of(apply_rules(docs, order=names[::-1]), "doc_id", "kept") == rows_of(apply_rules(docs, order=sorted(names)), "doc_id", "kept") == rows_of(got, "doc_id", "kept")
    assert apply_rules(none).count() == 0


def test_rules_reject_as_plain(spark):
    texts = ["word " * 60, "# " * 30 + "a b c d e f g h i j", "go! now! stop! why! who! what! when! where! how! never! again! maybe", "ALL OF THIS TEXT IS WRITTEN IN CAPITAL LETTERS ONLY FOR NO GOOD REASON", "1 22 333 4444 55555 666 77 8 99 100 2000 30000 4 five", "\n".join(["same line here"] * 2 + [""] * 9 + ["another one now and then"]), prose(30), "ÄÖÜ ÉÈ ß ñandú " + prose(12)]

    def plain(t):
        w, ls = WORD.findall(t), t.split("\n")
        letters, chars = sum(map(str.isalpha, t)), sum(map(len, w))
        rules = [10 * len(re.findall(r"[#*$%&|<>]", t)) > 3 * len(w), 10 * t.count("!") > 5 * len(w), 2 * sum(map(str.isupper, t)) > letters, 2 * letters < chars, len(w) >= 50 and 10 * len(set(w)) < len(w) and len(set(w)) < 40, len(ls) >= 5 and 2 * len(set(ls)) < len(ls)]
        return not (len(w) < 10 or 100 * repeats(w) > 20 * len(w) or any(rules))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(apply_rules(df), "doc_id", "kept") == [[i, plain(t)] for i, t in enumerate(texts)]


def test_order_takes_most_rejected_for_the_cost_of_what_is_left():
    f = frozenset
    order = greedy({"a": 1.0, "b": 1.0, "c": 3.0, "d": 1.0}, {f("ab"): 50, f("a"): 10, f("bc"): 5, f("c"): 30, f(): 5})
    assert [x[0] for x in order] == ["a", "c", "b", "d"] and order[0][2] == 0.6 and order[1][2] == 35 / 40


def plain_near(rows, percent):
    def shingles(t):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [[i, len(s), least.get(find(k))] for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_dedup_equals_all_pairs(docs, none):
    got = rows_of(near_duplicates(docs, 85), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near([r[:2] for r in ROWS], 85), key=repr)
    assert near_duplicates(none, 85).count() == 0


@pytest.mark.parametrize("small", [8, 2])
def test_near_dedup_of_a_large_group_equals_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    words = [f"v{i}" for i in range(90)]
    rows = []
    for k in range(110):
        w = list(words)
        for j in rng.integers(0, 90, rng.integers(0, 5)):
            w[j] = f"n{rng.integers(0, 400)}"
        rows.append((k * 3, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(near_duplicates(df, 80), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain_near(rows, 80), key=repr) and len({r[2] for r in got}) > 1


def test_near_dedup_of_two_thousand_variants(spark):
    base, rows = [f"v{i}" for i in range(150)], []
    for k in range(2000):
        w = list(base)
        for j in rng.integers(0, 150, rng.integers(0, 7)):
            w[j] = f"n{rng.integers(0, 60 if k % 3 else 10**6)}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    at = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((2000, len(at)), np.float32)
    for k, s in enumerate(sets):
        has[k, [at[g] for g in s]] = 1
    common, n = has @ has.T, has.sum(axis=1)
    linked = 100 * common >= 85 * (n[:, None] + n[None, :] - common)
    root = np.arange(2000)
    while (least := np.where(linked, root[None, :], 2000).min(axis=1)).tolist() != root.tolist():
        root = least
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == list(enumerate(root.tolist()))
    assert len(set(root.tolist())) > 100


def test_what_a_family_compares_is_far_below_all_pairs(spark, monkeypatch):
    seen = {}

    def counted(star, percent, pairs=near_dedup.delta_pairs):
        out = pairs(star, percent)
        seen.update(classes=star.count(), members=star.agg(F.sum(F.size("members"))).first()[0], pairs=out.count())
        return out

    monkeypatch.setattr(near_dedup, "delta_pairs", counted)
    base, rows = [f"v{i}" for i in range(150)], []
    for k in range(600):
        w = list(base)
        for j in rng.integers(0, 150, 1 + k % 8):
            w[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).count()
    assert seen["members"] <= seen["classes"] * 28 and seen["classes"] < 2 * 600 and seen["pairs"] < 600 * 600 / 20


def test_secret_scan(spark, docs, none):
    key = "AKIA" + "Q7XW2ZP9LM4RT8VB"
    df = spark.createDataFrame([(1, f"my key {key} is here", "src0"), (2, "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixes it", "docs/a.md"), (3, None, None), (4, "plain words only " * 500, "web")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in scan_secrets(df).collect()}
    assert set(got) == {1, 2} and got[1]["is_secret"] and got[1]["candidate"] == key and got[1]["start"] == 7 and not got[2]["is_secret"]
    runs = sum(len(x.rstrip(".-")) >= 12 for _, t, _ in ROWS for x in re.findall(r"[A-Za-z0-9+/_.-]{12,}", t or ""))
    assert scan_secrets(none).count() == 0 and scan_secrets(docs).count() == runs > 0


def test_secret_scan_finds_every_run(spark):
    aws, github, plain = "AKIA" + "Q7XW2ZP9LM4RT8VB", "ghp_" + "abcdEFGH1234ijklMNOP5678", "9b0bd52b5c0e4e0e8f3c6a1d27e937a8"
    texts = [f'{{"api_key":"{aws}","token":"{github}"}}', f"aws_key={aws};region=eu-central-1", f"token={plain}&session=abcdefghijkl", f"a,{aws},b", f"<key>{aws}</key>", f"`{github}`", f"{{{aws}}}", f"***{aws}", f"日本語 secret:{aws},🎉{github}. end", "internationalization it is.", ",".join([aws] * 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("src0"))
    got = scan_secrets(df).collect()
    runs = [(i, m.start(), m.group().rstrip(".-")) for i, t in enumerate(texts) for m in re.finditer(r"[A-Za-z0-9+/_.-]{12,}", t)]
    assert sorted((r["doc_id"], r["start"], r["candidate"]) for r in got) == sorted(r for r in runs if len(r[2]) >= 12)
    assert all(r["length"] == len(r["candidate"]) and r["is_secret"] == (r["candidate"] in (aws, github, plain)) for r in got)


def test_secrets_of_the_documents(spark):
    """Precision and recall on whole documents, whose keys have a form that no labelled finding has."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    planted = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    got = scan_secrets(docs).collect()
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["candidate"] for r in got)
    said = {(r["doc_id"], r["start"]) for r in got if r["is_secret"]}
    assert len(planted) > 10 and len(said & planted) >= 0.95 * len(planted) and len(said & planted) >= 0.95 * len(said)


def test_secrets_of_ties_repeats_and_long_words(spark):
    key = "AKIA" + "Q7XW2ZP9LM4RT8VB"
    rows = [(1, f"key {key} and"), (1, f"key {key} and"), (2, f"key {key} and"), (None, f"key {key} and"), (3, "x" * 100_000), (4, "a" + "1b" * 20_000)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), path_col=None).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([1, 1, 2, None, 3, 4]) and len({r["score"] for r in got if r["candidate"] == key}) == 1
    assert {r["length"] for r in got} == {20, 100_000, 40_001}
    assert scan_secrets(spark.createDataFrame([(1, "pw=hunter2")], "doc_id long, text string"), path_col=None, least=7).count() == 1


def test_language_is_that_of_the_whole_corpus(spark):
    words = ["house", "mouse", "house", "the", "the", "the"]
    language = learn_language(spark.createDataFrame([(" ".join(words) + ". x9ab Über",), (None,), ("house,",)], "text string"), "text", Scratch(spark, "test"), 1)
    assert {r["word"]: r["c"] for r in language.words.collect()} == {"house": 3, "mouse": 1, "the": 3}
    n = {"ou": 4, "he": 3}
    row = {p[1]: 1.0 for p in (f"o{chr(c)}" for c in range(97, 123))} | {"u": 5.0}
    assert language.transitions[14 * 26 + 20] == pytest.approx(math.log10((1 + n["ou"]) / sum(row.values())))


def test_classifier(spark, docs, none):
    good = [(i, " ".join(rng.choice([f"word{j}" for j in range(300)], 60)) + ".") for i in range(300)]
    bad = [(1000 + i, "BUY NOW!!! $$$ " * 15) for i in range(300)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5, None)], "doc_id long, quality int")
    got = classify_quality(df, labels).collect()
    assert len(got) == 600 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] < 1000) for r in held) / len(held) > 0.97
    assert {r["doc_id"] for r in keep_quality(df, labels).collect()} == {r["doc_id"] for r in got if r["predicted"]}
    assert classify_quality(docs, labels).count() == len(ROWS) and classify_quality(none, labels).count() == 0
    assert {r["score"] for r in classify_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_title_case_is_counted_over_the_whole_text():
    words = (["Title"] + ["plain"] * 4) * 200
    assert text_statistics(" ".join(words))[-1] == pytest.approx(0.2)
    # The stride of a sample meets only one of the two kinds.
    assert text_statistics(" ".join(["Title", "plain"] * 200))[-1] == pytest.approx(0.5)


def test_isotonic_pools():
    knots, values = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert values.tolist() == [0, 0, 0.5, 0.5, 1, 1] and knots.tolist() == [1, 1, 2, 3, 4, 4]


def test_lm_base_and_model(spark, docs, none):
    got = score_documents(docs).collect()
    tokens = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + ["\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t, _ in ROWS if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = [[i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)] for i, t, _ in ROWS]
    assert sorted(([r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)] for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert score_documents(none).count() == 0


def test_lm_beats_the_base_on_held_out_order(spark):
    cycle = ["one", "two", "three", "four", "five", "six"]
    df = spark.createDataFrame([(i, " ".join(cycle[(i + j) % 6] for j in range(60))) for i in range(400)], "doc_id long, text string")
    held = score_documents(df).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > 0.6 * held["b"]


def test_bpe_takes_large_batches_in_small_steps():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{j}" for j in range(3000)) for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], ["id", "text"])
    _bpe(path)
    tracemalloc.start()
    got = [r for out in encoded(iter([batch]), path) for r in out.column("decoded").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == texts and peak < 70 << 20


@pytest.mark.parametrize("places", [[], [0], [255, 256, 65_536, 2**32 - 1], list(range(5000)) * 3])
def test_lm_places_come_back(places):
    assert unsqueezed(pa.py_buffer(squeezed(np.array(places, np.uint32)))).tolist() == places


def test_lm_rows_of_weights_grow_with_the_corpus(spark, monkeypatch):
    words = np.array([f"w{k}" for k in range(4000)])
    df = spark.createDataFrame([(i, " ".join(words[rng.zipf(1.3, 1000) % 4000])) for i in range(640)], "doc_id long, text string").repartition(4)
    assert lm_scoring.SHARD_ROWS == 1 << 15
    sharded = score_documents(df).collect()
    # 65,536 rows a layer in any case; held by the driver now.
    monkeypatch.setattr(lm_scoring, "SHARD_ROWS", 1 << 16)
    want = {r["doc_id"]: r for r in score_documents(df).collect()}
    assert sharded[0]["train_tokens"] >= 1 << 19 and len(sharded) == len(want) == 640
    for r in sharded:
        assert r[:6] == want[r["doc_id"]][:6] and r["score"] == pytest.approx(want[r["doc_id"]]["score"], rel=1e-4)


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    jvm, context = spark._jvm, spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_lm_tokens_cross_the_shuffle_once(spark):
    words = np.array([f"w{k}" for k in range(4000)])
    df = spark.createDataFrame([(i, " ".join(words[rng.zipf(1.3, 1000) % 4000])) for i in range(640)], "doc_id long, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    got = score_documents(df).collect()
    assert got[0]["train_tokens"] // lm_scoring.TOKENS_A_ROW > lm_scoring.SHARD_ROWS and len(got) == 640
    # All documents' tokens, to their block and to their expert, and what comes back.
    assert shuffled(spark) - before < 20 * sum(r["n_tokens"] for r in got)


def test_lm_experts_share_frequent_contexts():
    busy = np.zeros(lm_scoring.WORDS + 1, np.int64)
    busy[[7, 8, lm_scoring.WORDS]] = 1 << 30
    same = np.full(20, 7, np.uint16), np.full(20, 200, np.uint8)
    experts = lambda docs: np.concatenate([lm_scoring.expert_of(w, busy, 64) for w in lm_scoring.windows(docs)])
    # The same document many times: its copies differ by their ids alone.
    copies = experts([(*same, zlib.crc32(str(k).encode())) for k in range(10_000)])
    assert np.bincount(copies, minlength=64).max() < 1.5 * len(copies) / 64
    assert (experts([(*same, 5)]) == experts([(*same, 5)])).all()
    # A word that isn't frequent chooses alone, and behind a frequent one the word before that.
    rare, after = (np.unique(experts([(np.array([k, n, 7, 1], np.uint16), np.array([200] * 4, np.uint8), k) for k in (20, 30, 40)])[at::4]) for n, at in ((9, 2), (9, 3)))
    assert len(rare) == len(after) == 1


def test_lm_events_and_shares_come_back():
    columns = [np.arange(5, dtype=np.uint8), np.array([0, 1, 256, 65_535, 7], np.uint16), np.array([0, 1 << 31, 3, 4, 5], np.uint32), np.array([0.5, -1, 3e9, 0, -0.25], np.float32)]
    for n in (0, 5):
        got = lm_scoring.unplaned(pa.py_buffer(lm_scoring.planes([c[:n] for c in columns])), ["u1", "<u2", "<u4", "<f4"])
        assert [g.tolist() for g in got] == [c[:n].tolist() for c in columns]


def test_lm_is_a_distribution_over_parts_of_classes():
    model = MaxEnt(rng.integers(0, 50, (CLASSES, GROUPS)).astype(float), 256)
    for w in model.weights:
        w += rng.normal(0, 0.5, w.shape).astype(np.float32)
    # After the same two words every class, and every part of a class of many words, has a probability; together 1.
    ends = [(0, c) for c in range(SINGLES)] + [(p, c) for c in range(SINGLES, CLASSES) for p in range(GROUPS)]
    head = (np.array([7, 70], np.uint16), np.array([3, 200], np.uint8))
    docs = [(np.append(head[0], np.uint16(p)), np.append(head[1], np.uint8(c))) for p, c in ends]
    assert (10 ** (model.scores(docs) - model.scores([head])[0])).sum() == pytest.approx(1, abs=1e-4)


def test_lm_first_gradient_equals_the_general_one():
    mass = rng.integers(1, 50, (CLASSES, GROUPS)).astype(float)
    docs = [(rng.integers(0, 1 << 16, n).astype(np.uint16), rng.integers(0, CLASSES, n).astype(np.uint8)) for n in (1, 3, 400)]
    model = MaxEnt(mass, 256)
    first, general = ([np.zeros((256, GROUPS + 1), np.float32) for _ in range(3)] for _ in range(2))
    counts = model.first_counts()
    model.first_gradient(docs, first, counts)
    model.first_expected(first, counts)
    model.gradient(docs, general)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(first, general, strict=True))


def test_lm_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = score_documents(docs).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert r[0] > -3.72 and r[1] < -4.0


def test_token_files_round_trip(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    manifest = write_token_files(docs, path)
    got = sorted((r.asDict() for r in read_token_files(manifest, ids=True).collect()), key=lambda r: r["start"])
    want = {}
    for i, x, _ in ROWS:
        want.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [1])
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in want[r["doc_id"]] and r["start"] == at and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += len(ids)
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i or 0))
    assert read_token_files(write_token_files(none, path)).count() == 0


def test_token_encoder_equals_the_library_on_odd_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    odd = ["", " ", "\n\n", "a\0b", "\0", "x\x1cy \x1d", "e\u0301 a\u0308", "\u0301 alone", "İSTANBUL ŉ ſ", "no\u00a0break\u2003wide", "don't WE'LL it's 'S", "1234 ½ ²", "日本語 テキスト", "🎉🎉 x🎉", "<unk> [UNK]<s></s>", *(x or "" for x in TEXTS)]
    encoder = Encoder(path)
    for some in (odd, odd[::-1], [""], []):
        ids, sizes = encoder.encode(pa.array(some, pa.string()), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in some]


def test_token_files_refuse_ids_that_are_not_numbers(spark):
    with pytest.raises(TypeError):
        write_token_files(spark.createDataFrame([("b", "x")], "doc_id string, text string"), "unused")


def test_bpe_equals_the_library(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    want = []
    for i, x, _ in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append([i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()])
    assert rows_of(token_digests(encode_documents(docs, path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    bpe = ByteBPE(path)
    assert all(bpe.merge(w) == bpe.merge_long(w) for w in (b"", b"a", b"hello", b"x" * 90, "日本語テキスト".encode() * 5))
    assert encode_documents(none, path).count() == 0


def test_merging_together_equals_one_by_one_and_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe, t = ByteBPE(path), Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    for n in (1, 2, 7, 23):
        words = [bytes(rng.choice(list(b"aeiounrst the"), n).tolist()) for _ in range(200)]
        ids, sizes = bpe.merge_together(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [bpe.merge(w) for w in words]
    odd = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "\u00a0 x", "x\u3000 y", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "e\u0301 İ ŉ", "日本語 テキスト", "it's 'S we'LL", "tab\tsep\n\nline", "x" * 300, "🎉 🎉🎉", "\x85 \x1c \0", *(x or "" for x in TEXTS)]
    for some in (odd, odd[::-1], [""], ["a  b"], []):
        ids, sizes = bpe.encode_all(pa.array(some, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in some]
        assert bpe.decode_all(ids, [0, *np.cumsum(sizes).tolist()]) == [t.decode(t.encode(x, add_special_tokens=False).ids, skip_special_tokens=False) for x in some]
