"""Each query against a plain-Python account of the same job on a small table, or on cases made here."""

import re
from collections import defaultdict

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def rows(spark, name):
    return {tuple(r) for r in entry.queries()[name](spark, SF).collect()}


def written(s):
    m = re.search(r"([A-Z]{3})[^A-Z0-9]*(\d+)", s.upper())
    return f"{m[1]}_{int(m[2]):03d}"


def test_p1_every_divided_person(spark):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in zip(*(map(written, read("writer_links")[c]) for c in ("writer_a", "writer_b"))):
        a, b = sorted((root(a), root(b)))
        up[b] = a
    splits = defaultdict(set)
    for f, s in read("split_manifest")[["file_name", "split"]].itertuples(index=False):
        if isinstance(s, str):
            x = f.split("_")
            splits["split_manifest", root(written(x[1] + x[3]))].add(s.strip().lower())
    for d, k, s in read("l1_dataset")[["dataset", "key", "split"]].itertuples(index=False):
        if isinstance(s, str):
            splits[d, root(written(k.split("|")[0]))].add(s.strip().lower().replace("validation", "dev"))
    assert rows(spark, "p1_found") == {k for k, v in splits.items() if len(v) > 1}


def test_p1_long_chain_is_one_person(spark):
    from corpus.llm.splits import components

    links = spark.createDataFrame([(f"CHN_{i:03d}", f"CHN_{i + 1:03d}") for i in range(60)] + [("JPN_002", "JPN_001")], "a string, b string")
    names = {r.member: r.name for r in components(links).collect()}
    assert len(names) == 63
    assert {v for k, v in names.items() if k[0] == "C"} == {"CHN_000"}
    assert names["JPN_002"] == "JPN_001"


def test_p3_counts_words_of_repeated_runs():
    from corpus.llm.repetition import is_repetitive, repeated_words

    w = "a b c d e f g h".split()
    assert repeated_words(w) == 0
    assert repeated_words(w + ["x"] + w[:6]) == 6
    assert repeated_words(["so"] * 12) == 11
    assert is_repetitive("So much, so much! " * 20)
    assert not is_repetitive("")


def test_p4_every_unmet_target(spark):
    names = {"c0": "zero_shot", "c1": "one_shot", "c2": "few_shot", "c3": "cot"}
    have = defaultdict(set)
    for i, t, m, c, x in read("generated_corpus")[["source_id", "topic", "model_id", "condition", "generated_text"]].itertuples(index=False):
        if isinstance(x, str) and x.strip(" \n\t\r﻿"):
            c = re.sub(r"[-\s]", "_", c.strip().lower())
            have["generated_corpus", i[:3], names.get(c, c)].add((i, t, m))
    for f, t, s, x in read("split_manifest")[["file_name", "topic", "split", "text"]].itertuples(index=False):
        if isinstance(s, str) and s.strip().lower() == "pool" and isinstance(x, str) and x.strip(" \n\t\r﻿"):
            have["split_manifest", f.split("_")[1], "all"].add((f.split("_")[3], t))
    want = set()
    for r in read("sample_targets").itertuples():
        need = max(r.min_rows, (round(r.target_share * 10**9) * r.sample_rows + 10**9 // 2) // 10**9)
        if len(have[r.source_table, r.region, r.condition]) < need:
            want.add((r.target_set, r.region, r.condition))
    assert rows(spark, "p4_found") == want


def test_p8_ids_of_all_documents(spark):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in entry.queries()["p8_ids"](spark, SF).collect()}
    d = read("documents")
    assert got == {i: t.encode(x, add_special_tokens=False).ids if isinstance(x, str) else [] for i, x in zip(d.doc_id, d.text)}


def test_p2_every_pair(spark):
    import itertools
    import unicodedata

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    sides = defaultdict(lambda: ([], []))
    small = "/root/testdata/sf0.001"
    m, d = pd.read_parquet(f"{small}/split_manifest.parquet"), pd.read_parquet(f"{small}/l1_dataset.parquet")
    for scope, r, s, x in [*zip(itertools.repeat("m"), m.rec_id, m.split, m.text), *zip(d.dataset, d.rec_id, d.split, d.text)]:
        if isinstance(s, str) and isinstance(x, str):
            w = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", x).lower())
            if len(w) >= 20:
                sides[scope][s.strip().lower() in ("test", "dev", "validation")].append((r, w))
    want = set()
    for train, held in sides.values():
        for (r, a), (q, b) in itertools.product(train, held):
            longer = max(len(a), len(b))
            if 5 * min(len(a), len(b)) >= 4 * longer and 5 * len(set(a) & set(b)) > len(set(a)) and 5 * lcs(a, b) >= 4 * longer:
                want.add((min(r, q), max(r, q)))
    got = {tuple(r) for r in entry.queries()["p2_found"](spark, small).collect()}
    assert want and got == want


def test_p2_evenly_spread_changes():
    from corpus.llm.overlap import near_same

    a = [f"w{i}" for i in range(100)]
    assert near_same(a, [x if i % 5 else f"y{i}" for i, x in enumerate(a)])
    assert not near_same(a, [x if i % 5 and i != 1 else f"y{i}" for i, x in enumerate(a)])
    assert near_same(a[:20], a[:25]) and not near_same(a[:19], a[:19])


def test_p6_every_pair(spark):
    small = "/root/testdata/sf0.001"
    g, p = pd.read_parquet(f"{small}/generated_corpus.parquet"), pd.read_parquet(f"{small}/exemplar_pool.parquet")
    names = {"c0": "zeroshot", "c1": "oneshot", "c2": "fewshot", "c3": "cot"}
    spell = lambda c: (lambda s: names.get(s, s))(re.sub(r"[^a-z0-9]", "", c.lower()))
    recs = [(r, (i, t, m, spell(c)), x) for r, i, t, m, c, x in zip(g.rec_id, g.source_id, g.topic, g.model_id, g.condition, g.generated_text)]
    recs += [(r, None, x) for r, x in zip(p.rec_id, p.text)]
    where = defaultdict(set)
    for k, (r, c, x) in enumerate(recs):
        if isinstance(x, str):
            x = re.sub(r"\s+", " ", x)
            for i in range(len(x) - 299):
                where[x[i : i + 300]].add(k)
    want = set()
    for ks in where.values():
        for a in ks:
            for b in ks:
                (r, c, _), (q, d, _) = recs[a], recs[b]
                if r < q and (c or d) and c != d:
                    want.add((r, q))
    assert want and {tuple(r) for r in entry.queries()["p6_found"](spark, small).collect()} == want


def test_p6_stretch_of_exactly_300():
    import random

    from corpus.llm.spans import common_ends, kept_kmers, surroundings

    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    for n, same in ((300, True), (299, False)):
        s = make(n)
        a, b = make(100) + "1" + s + "2" + make(50), make(17) + "3" + s + "4" + make(200)
        (p,), (q,) = surroundings(a, [101 + 50]), surroundings(b, [18 + 50])
        assert common_ends(p, q) == (50, n - 250)
        shared = set(kept_kmers(a)[0]) & set(kept_kmers(b)[0])
        assert not same or shared


def test_p5_lists_tables_and_loose_words():
    from corpus.llm.prose import is_no_prose

    for x in ("\n".join(f"- useful result {i}" for i in range(40)), "| item | score |\n|---|---|\n" + "| deep lesson | 12 |\n" * 30, "share, plan, owner, daily, repair, care, serve, children, count, bakery " * 8, "<ul>" + "<li class='c1'>small rule</li>" * 40 + "</ul>", "%{}#@ " * 50):
        assert is_no_prose(x)
    for x in ("- I think that it is good for us to work.\n" * 12, "SHOULD WE BAN IT? I THINK THAT IT IS THE RIGHT OF THE OWNER.", "I'm sorry, but I cannot write this essay.", "so much " * 90, " \n"):
        assert not is_no_prose(x)


def test_p7_endings():
    from corpus.llm.truncation import ends_marked, loop_ends

    for x in ("It is so.", "Is it so?”", "It is so. Thank you for reading", "It is so :)", "It is so. (the end)"):
        assert ends_marked(x)
    for x in ("It is s", "It is s...", "It is s…", "It is -", "It is the"):
        assert not ends_marked(x)
    assert loop_ends("I say no, " + "no, " * 20 + "n") is False
    assert loop_ends("I say " + "go home now " * 8 + "go home") is False
    assert loop_ends("I say " + "go home now " * 8) is True
    assert loop_ends("This is an essay that goes on and on without a phrase said again") is None


def test_p5_p7_agree_and_have_rows(spark):
    p5, p7 = rows(spark, "p5_found"), rows(spark, "p7_found")
    assert p5 and p7 and not p5 & p7


def test_p9_every_token_once_and_little_room_left(spark):
    counts = {r.doc_id: len(r.ids) for r in entry.queries()["p8_ids"](spark, SF).collect()}
    got = entry.queries()["p9_packed"](spark, SF).toPandas()
    for r in read("pack_profiles").itertuples():
        mine = got[got.profile == r.profile]
        assert set(mine.doc_id) == set(counts)
        for doc, x in mine.sort_values("start").groupby("doc_id"):
            assert list(x.start) == [0, *x.tokens.cumsum()[:-1]] and x.tokens.sum() == counts[doc]
            assert len(x) == 1 or counts[doc] > r.capacity_tokens
        full = mine.groupby("container").tokens.sum()
        assert full.max() <= r.capacity_tokens
        assert full.sum() >= 0.98 * r.capacity_tokens * len(full)


def test_p10_languages(spark):
    from corpus.llm.language import decide, label, trained, units

    model = trained(spark, SF)
    held = lambda text: {d[0] for _, u in units(text) if (d := decide(model, u))}
    assert held("ถ้ามีคนสูบบุหรี่ในร้านอาหาร เพื่อนของฉันจะรู้สึกไม่สบาย In fact, it is the right of the owner.") == {"th", "en"}
    assert held("Ibu saya pernah berkata bahwa udara bersih lebih penting. 如果很多学生没有休息，就会失去经验。") == {"id", "zh"}
    assert held("Hotel mein cigarette ka dhuan talba ko bohat tang karta hai.") == {"ur"}
    assert held("Like adobo, the cost of the tests is low for most of us.") == {"en"}
    assert not held("") and not held("xq zzv; pqr wlk bnn.") and not held("12 34 !!")
    assert [label(x) for x in ("en_GB", "fil", "zh-Hant", "ENGLISH ", "und", "??", None)] == ["en", "tl", "zh", "en", None, None, None]


def test_p10_rows(spark):
    assert rows(spark, "p10_found")


def test_p6_batches_without_long_texts(spark, tmp_path):
    for name in ("generated_corpus", "exemplar_pool"):
        x = pd.read_parquet(f"/root/testdata/sf0.001/{name}.parquet")
        x[:0].to_parquet(tmp_path / f"{name}.parquet")
    assert entry.queries()["p6_found"](spark, str(tmp_path)).count() == 0


def test_p6_kmers_of_short_texts():
    from corpus.llm.spans import kept_kmers

    assert all(kept_kmers(x)[0].dtype == "int64" for x in ("", "a" * 250, "a" * 299, "ab" * 400))


@pytest.mark.parametrize("name", ["p6_found", "p6_shared"])
def test_p6_gathers_no_table_on_the_driver(spark, monkeypatch, name):
    """Kept tables are small files here as they may be at any size; none may be broadcast for that."""
    from corpus.llm import spans

    plans, keep = [], spans.kept

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(spans, "kept", seen)
    last = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]
