"""The text-corpus operators: against brute force, exact round trips, and on odd input."""

import collections
import json
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteweave.llm import queries as Q
from noteweave.llm.cooccurrence import CLASSES, _classes, fit_null, log_upper_tail, pair_counts, solve_fitness, surprising_pairs
from noteweave.llm.discovery import with_q_values
from noteweave.llm.encoding import TOKENIZERS, TreeCodec, decode_corpus, encode_corpus
from noteweave.llm.leakage import SEEDS, blocks, find_leaks, make_block, words
from noteweave.llm.truncation import SPAN, _word_odds, find_truncated, length_hazards, poisson_tail

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


# pairs


def baskets(spark, data):
    return spark.createDataFrame([(i, s, "clash") for i, s in enumerate(data)], "basket int, items array<string>, n string")


def brute_pairs(data, min_count=3, min_share=0.0, min_lift=0.0):
    sets = [{x for x in s or [] if x is not None} for s in data]
    sets = [s for s in sets if s]
    single = collections.Counter(x for s in sets for x in s)
    pair = collections.Counter((a, b) for s in sets for a in s for b in s if a < b)
    return {(a, b): n for (a, b), n in pair.items() if n >= min_count and n >= min_share * len(sets) and n * len(sets) / (single[a] * single[b]) > min_lift}


def test_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    names = [f"t{i}" for i in range(30)] + ["Z", "é"]
    data = [rnd.choices(names, [1 / (i + 1) for i in range(len(names))], k=rnd.randint(0, 9)) for _ in range(400)] + [None, [], [None, "t1"], names, names, ["t1"] * 50]
    for more in ({}, {"min_count": 1}, {"min_share": 0.02}, {"min_lift": 1.5}, {"min_share": 0.01, "min_lift": 1.2}):
        got = surprising_pairs(baskets(spark, data), **more).collect()
        assert {(r["a"], r["b"]): r["n"] for r in got} == brute_pairs(data, **more)
        assert all(0 <= r["q_value"] <= 1 and r["log10_p"] <= 0 for r in got)


def test_pairs_of_nothing(spark):
    for data in ([], [None], [["a"]], [[]]):
        assert surprising_pairs(baskets(spark, data), min_count=1).count() == 0


def test_a_planted_pair_surprises_and_chance_does_not(spark):
    rnd = random.Random(5)
    names = [f"t{i}" for i in range(40)]
    data = [rnd.sample(names, rnd.randint(2, 8)) + (["x", "y"] if i % 20 == 0 else []) for i in range(1000)]
    got = {(r["a"], r["b"]): r for r in surprising_pairs(baskets(spark, data)).collect()}
    assert got["x", "y"]["q_value"] < 1e-20 and sum(r["q_value"] < 0.01 for k, r in got.items() if "x" not in k) == 0


def test_null_keeps_frequencies_and_sizes():
    freq, n_items, size, n_baskets = np.array([1.0, 5, 50]), np.array([30.0, 10, 2]), np.array([1.0, 2, 7]), np.array([40.0, 20, 100 / 7])
    x, y = fit_null(freq, n_items, size, n_baskets)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ n_baskets, freq, rtol=1e-4) and np.allclose(n_items @ p, size, rtol=1e-4)


def test_null_above_the_bound_of_classes():
    freq, n_items, size, n_baskets = np.arange(1, 1201), np.ones(1200), np.array([10.0, 40, 100]), np.array([5000.0, 10_000, 2706])
    f, n, group = _classes(freq, n_items, CLASSES)
    x, y = fit_null(f, n, size, n_baskets)
    shared, own = x[group], solve_fitness(freq, y, n_baskets, x[group])
    gap = lambda v: np.abs((np.outer(v, y) / (1 + np.outer(v, y))) @ n_baskets / freq - 1).max()
    assert len(f) < 1200 and gap(own) < 1e-6 and gap(shared) > 1e-3


def test_pairs_are_tested_alike_when_frequencies_share_classes(spark):
    data = [[f"t{j}" for j in range(40) if (i * (2 * j + 3)) % 83 < 2 * j + 1][:30] for i in range(300)]
    whole, merged = ({(r["a"], r["b"]): r["expected"] for r in surprising_pairs(baskets(spark, data), **more).collect()} for more in ({}, {"classes": 8}))
    assert whole.keys() == merged.keys() and max(abs(merged[k] / whole[k] - 1) for k in whole) < 0.05


def test_tails_against_convolution():
    rng = np.random.default_rng(1)
    q, m = np.minimum(rng.gamma(0.5, 0.05, (150, 6)) * rng.uniform(0, 6, (150, 1)), 0.95), np.array([400, 200, 60, 20, 3, 1])
    n, want = np.zeros(150, int), []
    for i in range(150):
        p = np.ones(1)
        for s, k in enumerate(m):
            for _ in range(k):
                p = np.convolve(p, [1 - q[i, s], q[i, s]])
        n[i] = max(0, int(q[i] @ m + rng.uniform(-1.5, 6) * np.sqrt((q[i] * (1 - q[i])) @ m)))
        want.append(np.log10(p[n[i] :].sum()))
    assert np.abs(log_upper_tail(n, q, m.astype(float)) - want).max() < 0.02


def test_q_values(spark):
    p = sorted(random.Random(2).random() ** 4 for _ in range(300)) + [0.5, 0.5]
    df = spark.createDataFrame([(i, float(np.log10(x))) for i, x in enumerate(p)], "i int, log10_p double")
    got = [r["q_value"] for r in with_q_values(df, 1000).orderBy("i").collect()]
    raw = [min(1.0, x * 1000 / sum(y <= x for y in p)) for x in p]
    want = [min(r for r, y in zip(raw, p) if y >= x) for x in p]
    assert np.allclose(got, want, rtol=1e-6)


def test_a_million_ties_fill_many_tasks(spark):
    df = spark.range(1_000_000).select("id", F.when(F.col("id") < 50, -F.col("id") / 5.0).otherwise(0.0).alias("log10_p"))
    got = with_q_values(df, 2_000_000).withColumn("task", F.spark_partition_id())
    assert got.groupBy("task").count().agg(F.max("count")).collect()[0][0] < 600_000
    rows = {r["id"]: r["q_value"] for r in got.where("id < 60").collect()}
    raw = [min(1.0, 10 ** (-i / 5) * 2_000_000 / (50 - i)) for i in range(50)]
    assert np.allclose([rows[i] for i in range(50)], [min(raw[: i + 1]) for i in range(50)]) and {rows[i] for i in range(50, 60)} == {1.0}


def test_q_values_rank_among_all_pairs(spark):
    rnd = random.Random(6)
    data = [rnd.sample([f"t{i}" for i in range(25)], rnd.randint(2, 6)) for _ in range(200)] + [["t1", "t2"]] * 30
    whole = {(r["a"], r["b"]): r["q_value"] for r in surprising_pairs(baskets(spark, data), min_count=1).collect()}
    for more in ({"min_count": 12}, {"min_lift": 1.3}):
        got = {(r["a"], r["b"]): r["q_value"] for r in surprising_pairs(baskets(spark, data), **more).collect()}
        assert got and len(got) < len(whole) and all(whole[k] == q for k, q in got.items())


def test_long_baskets_are_dealt_out(spark):
    data = [[f"t{i:03d}" for i in range(k)] for k in (60, 60, 45, 3)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(data)], "basket int, items array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in pair_counts(df, long_basket=10).collect()}
    assert got == brute_pairs(data, 1)


def test_p3_surprise_keeps_rare_pairs_of_many_pages(spark, tmp_path):
    tags = F.when(F.col("id") < 3, F.array(F.lit("#Rare a"), F.lit("rare b"))).when(F.col("id") < 5, F.array(F.lit("twice a"), F.lit("twice b"))).otherwise(F.array(F.concat(F.lit("t"), F.col("id") % 50))).alias("tags")
    pages = spark.range(16_000).select(F.concat(F.lit("p"), "id").alias("page_path"), tags, F.lit(1).cast("long").alias("revision"), F.lit("2024-01-01").cast("timestamp").alias("loaded_at"))
    pages.write.parquet(f"{tmp_path}/vault_pages.parquet")
    got = Q.p3_surprise(spark, str(tmp_path)).collect()
    assert [(r["a"], r["b"], r["n"], r["n_a"], r["n_b"], r["baskets"]) for r in got] == [("rare a", "rare b", 3, 3, 3, 16_000)] and got[0]["q_value"] < 1e-3


def test_p3_found(spark):
    pages = {}
    for r in spark.read.parquet(f"{SF}/vault_pages.parquet").collect():
        if r["page_path"] is not None and (r["page_path"] not in pages or (r["revision"], r["loaded_at"]) > pages[r["page_path"]][0]):
            pages[r["page_path"]] = ((r["revision"], r["loaded_at"]), r["tags"])
    data = [[x for t in tags or [] if t and (x := t.strip().lstrip("#").strip().lower())] for _, tags in pages.values()]
    want = {k for k, n in brute_pairs(data, 3).items() if n * 400 >= sum(map(bool, data))}
    single = collections.Counter(x for s in data for x in set(s))
    total = sum(map(bool, data))
    want = {(a, b) for a, b in want if 10 * brute_pairs(data, 3)[a, b] * total > 31 * single[a] * single[b]}
    assert {tuple(r) for r in Q.p3_found(spark, SF).collect()} == want


# token ids


@pytest.fixture(scope="module")
def codec():
    return TreeCodec(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_tree_equals_whole_encoding(codec):
    rnd = random.Random(1)
    signs = "a b\n\t 1'9sſ ,.日　\x1c\x85é́\U0001F600<|endoftext|>"
    for leaf in (1, 2, 5, 17, 1024):
        codec.leaf = leaf
        for _ in range(800):
            text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60)))
            ids = codec.encode(text)
            assert ids == codec.bpe.encode_ordinary(text) and codec.decode(ids) == text
    codec.leaf = 1024
    for text in ("a" * 20_000, " " * 20_000, "x y " * 50_000, "\n" * 9_999 + "z"):
        assert codec.encode(text) == codec.bpe.encode_ordinary(text)


def test_ids_of_documents(spark):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = Q.p6_ids(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(ids) == len(texts) and all(r["ids"] == (other.encode(texts[r["doc_id"]], add_special_tokens=False).ids if texts[r["doc_id"]] else []) for r in ids)


def test_odd_documents_and_decoding(spark):
    data = [(1, "héllo", "x"), (1, "héllo", "x"), (2, "", "x"), (3, None, "x"), (None, "z", "x"), (4, "w " * 100_000, "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    encoded = encode_corpus(df)
    got = collections.Counter((r["doc_id"], len(r["ids"])) for r in encoded.collect())
    assert got[1, 3] == 2 and got[2, 0] == got[3, 0] == 1 and sum(got.values()) == 6 and encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert collections.Counter(r["text"] for r in decode_corpus(encoded).collect()) == collections.Counter(t or "" for _, t, _ in data)
    assert encode_corpus(df.where("false")).count() == 0


# leaks


def brute_leaks(docs, items, n):
    out = set()
    for d, t in docs:
        text = words(t)
        for i, x in items:
            grams = {tuple(w[k : k + n]) for w in [words(x)] for k in range(len(w) - n + 1)}
            if any(tuple(text[k : k + n]) in grams for k in range(len(text) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["Éa", "日本", "x²"]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rnd.randint(0, 60)))) for i in range(25)] + [(25, None), (26, "")]
    docs = [(100, None), (101, ""), (102, "_-_ !")]
    for d in range(60):
        w, item = make(rnd.randint(0, 80)), (items[rnd.randrange(25)][1] or "").split(" ")
        size = rnd.choice([0, 17, 19, 20, 21, 40])
        at = rnd.randrange(max(1, len(item) - size + 1))
        docs.append((d, "_, ".join(w[:20] + [x.upper() for x in item[at : at + size]] + w[20:])))
    docs += docs[:10]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    tests = spark.createDataFrame([(*i, "x") for i in items], "item_id int, item_text string, text string")
    for size in (500_000, 40):
        got = find_leaks(frame, tests, block_words=size).collect()
        exact = {(r["doc_id"], r["item_id"]) for r in got if r["exact_words"] >= 20}
        assert exact == brute_leaks(set(docs), items[:25], 20) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got}) and len(exact) > 5
    assert find_leaks(frame, tests.where("false")).count() == 0 and find_leaks(frame.where("false"), tests).count() == 0


def test_leaks_with_replaced_words(spark):
    text = [f"u{i}" for i in range(60)]
    changed = list(text)
    changed[30] = "other"
    docs = spark.createDataFrame([(1, " ".join(changed[11:50])), (2, " ".join(text[:19])), (3, " ".join(text[:30] + ["more"] + text[30:]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(text))], "item_id long, item_text string")
    more = items.unionByName(spark.createDataFrame([(8, "nothing of the kind " * 10)], "item_id long, item_text string"))
    for tests, size in ((items, 500_000), (more, 30)):
        got = {r["doc_id"]: (r["exact_words"], r["similar_words"]) for r in find_leaks(docs, tests, block_words=size).collect()}
        assert got == {1: (19, 39), 3: (30, 30)}


def test_recall_of_replaced_words():
    """How many ways to replace two inner words leave no seed to hit, by the length of the passage."""
    missed = {}
    for n in (20, 21, 22, 23, 24, 25, 30):
        hit = lambda gone, n=n: any(all(s[p - o] == "0" for p in gone if 0 <= p - o < len(s)) for s in SEEDS for o in range(n - len(s) + 1))
        pairs = [(i, j) for i in range(1, n - 1) for j in range(i + 1, n - 1)]
        missed[n] = (sum(not hit(p) for p in pairs), len(pairs))
        assert all(hit((i,)) for i in range(1, n - 1))
    assert missed == {20: (6, 153), 21: (2, 171), 22: (1, 190), 23: (0, 210), 24: (0, 231), 25: (0, 253), 30: (0, 378)}


def test_blocks():
    assert [len(b) for b in blocks([(i, "a b c") for i in range(7)], 7)] == [2, 2, 2, 1] and list(blocks([])) == []
    assert all(len(s) <= 20 for s in SEEDS) and len(make_block([]).text) == 0


def test_p7_found(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/eval_items.parquet").select("item_id", "item_text").collect()]
    assert {tuple(r) for r in Q.p7_found(spark, SF).collect()} == brute_leaks(docs, items, 20)


# cut texts


def corpus(n=1500, seed=4):
    """Whole files of a few lines in two languages; returns texts and their languages."""
    rnd = random.Random(seed)
    noun = "kettle amber wagon pillar basket lantern meadow harbor thimble gravel needle orchard copper".split()
    out = []
    for _ in range(n):
        w = lambda: rnd.choice(noun)
        if rnd.random() < 0.5:
            lines = [x for _ in range(rnd.randint(8, 90)) for x in (f"def {w()}_{w()}({w()}):", f"    # {w()} {w()} {w()} {w()}", f"    return {w()}.{w()}({rnd.randint(1, 99)})", "")]
            out.append(("\n".join(lines[:-1]) + "\n", "python"))
        else:
            lines = [x for _ in range(rnd.randint(5, 60)) for x in (f"function {w()}({w()}) {{", f"  const {w()} = {w()} + {rnd.randint(1, 99)};", f'  return "{w()} {w()}";', "}", "")]
            out.append(("\n".join(lines[:-1]) + "\n", "js"))
    return out


def test_cuts_are_found_and_whole_files_left(spark):
    rnd, rows, cut = random.Random(9), [], set()
    for i, (text, lang) in enumerate(corpus()):
        source = ("limit", "blocks", "wire", "whole")[i % 4]
        if source == "limit" and len(text) > 2000:
            text, _ = text[:2000], cut.add(i)
        elif source == "blocks" and rnd.random() < 0.3 and len(text) > 1100:
            text, _ = text[: len(text) // 512 * 512], cut.add(i)
        elif source == "wire" and rnd.random() < 0.15:
            text = text[: rnd.randrange(40, len(text) - 2)]
            text += rnd.choice(["", "", "…", " [cut]"])
            cut.add(i)
        elif rnd.random() < 0.15:
            text = text.rstrip("\n")
        rows.append((i, text, lang, source))
    rows += [(5000, None, "js", "limit"), (5001, "", None, None), (5002, "  ", "js", "wire"), (5003, "x = 1\n", None, None), rows[0]]
    df = spark.createDataFrame(rows, DOC).withColumn("end", F.lit("clash"))
    got = find_truncated(df).collect()
    found = {r["doc_id"] for r in got if r["probability"] > 0.5}
    assert not found & {5000, 5001, 5002, 5003} and len(got) == len({r["doc_id"] for r in got}) == 1501
    assert len(found & cut) >= 0.93 * len(cut) and len(found - cut) <= 0.03 * len(found)
    assert {r["at_limit"] for r in got if r["source"] == "whole"} == {None}
    assert find_truncated(df.where("false")).count() == 0


def test_cuts_without_keys_and_with_long_words(spark):
    rows = [(None, "x = 1\n", "js", "s"), (1, "a" * 300_000, None, "s"), (2, "b " * 100_000, "js", None), *[(3, "y = 2\n", "js", "s")] * 50]
    got = find_truncated(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "None"]


def test_copies_of_a_file_are_no_limit(spark):
    texts = corpus(300, 8)
    rows = [(i, t, g, "s") for i, (t, g) in enumerate(texts)] + [(1000 + i, texts[0][0], "python", "s") for i in range(60)]
    got = find_truncated(spark.createDataFrame(rows, DOC)).collect()
    assert {r["at_limit"] for r in got if r["doc_id"] >= 1000} == {None} and not [r for r in got if r["probability"] > 0.5]


def test_hazards(spark):
    rows = [(f"t{i}", "s", 1000 if i % 10 == 0 else 500 + i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "t string, source string, chars long, content long").withColumn("bytes", F.col("chars"))
    got = {(r["unit"], r["length"]): r for r in length_hazards(df).collect()}
    assert got["chars", 1000]["q_value"] < 1e-20 and got["chars", 1000]["n"] == 90 and got["chars", 501]["q_value"] > 0.5
    whole, counts = length_hazards(df.where("source = 's'"), reach=64).where("unit = 'chars'").collect(), collections.Counter(r[2] for r in rows)
    for r in whole:
        near = [k for k in range(max(1, r["length"] - 64), r["length"] + 65) if k != r["length"]]
        risk = lambda k: sum(n for at, n in counts.items() if at >= k)
        assert r["at_risk"] == risk(r["length"]) and r["expected"] == pytest.approx(r["at_risk"] * (sum(counts[k] for k in near) + 0.5) / max(sum(map(risk, near)), 1))
    assert got["chars", 1399]["at_risk"] == 1 and poisson_tail(np.array([3, 1]), np.array([1.0, 2.0]))[0] == pytest.approx(np.log10(1 - 2.5 * np.exp(-1)), abs=1e-9)


def test_hazards_across_ranges(spark):
    rnd = random.Random(2)
    lengths = [SPAN * 2 - 3, SPAN * 2, SPAN * 2 + 1, SPAN * 2 + 60, 5, 1, SPAN * 7] + [rnd.randint(SPAN - 90, SPAN + 90) for _ in range(150)]
    df = spark.createDataFrame([("s", n, n, i) for i, n in enumerate(lengths)], "source string, chars long, bytes long, content long")
    got = {(r["unit"], r["length"]): (r["n"], r["at_risk"], r["expected"]) for r in length_hazards(df).collect()}
    counts = collections.Counter(lengths)
    for at, n in counts.items():
        near = [k for k in range(max(1, at - 64), at + 65) if k != at]
        risk = lambda k: sum(m for x, m in counts.items() if x >= k)
        assert got["chars", at] == (n, risk(at), pytest.approx(risk(at) * (sum(counts[k] for k in near) + 0.5) / max(sum(map(risk, near)), 1)))
        rest, ring = at % 512, collections.Counter(x % 512 for x in lengths)
        around = sum(ring[(rest + d) % 512] for d in range(-64, 65) if d)
        assert got["bytes in blocks of 512", rest] == (ring[rest], len(lengths), pytest.approx((around + 0.5) / 128))


def test_words_of_any_length_against_brute_force(spark):
    rnd = random.Random(11)
    tokens = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 3, 63, 64, 65, 66]))) for _ in range(60)] + ["a" * n for n in (64, 65, 70, 70, 500, 1000)] + ["ab" * 40] * 3
    df = spark.createDataFrame([(" ".join(tokens),), ("Ab1 ab",), (None,), ("",)], "text string")
    seen = collections.Counter(t.lower() for t in tokens + ["ab", "ab"])
    words = sorted({t[: rnd.randint(1, len(t))] for t in tokens} | {"a" * 65, "a" * 700})
    got = {r["word"]: r["word_odds"] for r in _word_odds(df, "text", spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    mean = sum(len(t) * n for t, n in seen.items()) / sum(seen.values())
    for w in words:
        some = sum(n for t, n in seen.items() if t.startswith(w))
        if some:
            assert got[w] == pytest.approx(max(some - 0.5, 0.5) / max(seen[w] - 0.5, 0.5) / mean)


def test_ends_of_long_lines_count_whole(spark):
    from noteweave.llm.truncation import _ending

    texts = {"x = [" + "1, " * 9000 + "\n": (True, "w = ", None), "(" + "word " * 30_000 + "half": (False, "(W", "half"), " " * 200_000 + "}": (False, ">}", ""), "a;\r\n\n": (True, "w;", None), "b" * 200_000: (False, "w", "b" * 200_000)}
    got = {r["t"]: r["e"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", _ending(F.col("t")).alias("e")).collect()}
    for t, (nl, start, word) in texts.items():
        assert (got[t]["nl"], got[t]["word"]) == (nl, word) and got[t]["shape"].startswith(start[:3])


def test_p8_found(spark):
    got = [r[0] for r in Q.p8_found(spark, SF).collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(set(got)) and all(texts[d] and texts[d].strip() for d in got)
    marked = {d for d, t in texts.items() if t and re.search(r"(…|\[cut\]|�)$", t)}
    assert marked <= set(got)


def test_every_query_is_registered():
    assert {"p3_found", "p6_ids", "p7_found", "p8_found"} <= set(Q.QUERIES) and json.dumps(sorted(Q.SQL))
