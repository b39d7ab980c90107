"""Scanned text, packing, splitting and leaks."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unifold.llm.leakage import build_index, find_leaks, words
from unifold.llm.packing import BUCKETS, fullest, item_sizes, pack, plan
from unifold.llm.pieces import split_core, split_documents, split_text
from unifold.llm.scanned import drop_page_lines, inspect_texts, is_page_line, misread_cost
from unifold.llm.tokens import boundaries, count

VOCAB = [f"{a}{b}" for a in ("plan", "river", "mast", "tower", "lamp", "grain", "metal", "corner") for b in ("ing", "er", "ed", "s", "work", "house", "side", "line")]


def passage(r, n):
    return [r.choice(VOCAB) for _ in range(n)]


def test_page_lines():
    for line in ("Page 3", "3", "[12]", "- 4 -", "p. 5", "3/4", "Seite 2", "CONFIDENTIAL", "Curriculum Vitae Ada de Stone", "CV – Ada Stone – page 2", "Ada Stone | Résumé | 4", "Ada Stone        1", "RESUME OF ADA STONE"):
        assert is_page_line(line), line
    for line in ("by 77%.", "", "page 2 of the campaign site.", "Kotlin", "Quarry Hill", "2 people left", "1. Led the team", "reaching 3"):
        assert not is_page_line(line), line
    assert drop_page_lines("landing page 2") == ("landing page 2", False) and drop_page_lines("3\n4") == ("3\n4", False)


def test_confusions_are_cheap():
    assert misread_cost("platform", "platforrn") == misread_cost("circle", "cirde") == 0.4
    assert misread_cost("circle", "circles") > 1 and misread_cost("modern", "modem") == 0.4


def scanned(spark, texts, **more):
    clean = ["the modern platform has information services for clients in the front-end team and information for services"] * 40
    df = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts + clean)], "n int, text string, damage string, repaired int")
    return {r.n: r for r in inspect_texts(df, **more).where(f"n < {len(texts)}").collect()}


def test_damage_and_repair(spark):
    texts = [
        "the modern plat-\nform has informafion\nPage 3\nservices for cli­\r\nents", "the front-\nend team for information", "the modern\nplatform", "- item one\n- item two", None, "", " \n ",
        "Front- and back-end work on m0 prototypes", "x" * 200_000, "serv- \n  \f3\nices for clients",
    ]
    got = scanned(spark, texts)
    assert got[0].damage == ["page_line", "split_word", "wrong_char"] and got[0].repaired == "the modern platform has information services for clients"
    assert got[9].damage == ["page_line", "split_word"] and got[9].repaired == "services for clients"
    for i in (1, 2, 3, 4, 5, 6, 7, 8):
        assert got[i].damage == [] and got[i].repaired == texts[i]


def test_candidates_are_complete(spark):
    """Every frequent word within the cost limit is found, however its pieces lie."""
    from unifold.llm.scanned import CONFUSIONS, misreadings, total_cost

    r = random.Random(3)
    true = ["communication", "commitment", "minimum", "comment", "recommend", "platform", "illumination", "classical", "numbers", "inn", "dim"]
    read = {"cornrnunication", "cornrnitrnent", "rninirnurn", "cornrnent", "recornrnend", "unknown"}
    for w in true * 12:
        for _ in range(r.choice((1, 2, 3))):
            t, x = r.choice(CONFUSIONS)
            if t in w:
                at = r.choice([i for i in range(len(w)) if w.startswith(t, i)])
                w = w[:at] + x + w[at + len(t) :]
        read.add(w)
    words = spark.createDataFrame([(w, 500) for w in true] + [(w, 1) for w in sorted(read - set(true))], "a string, n bigint")
    got = {(x.word, x.original) for x in misreadings(words).collect()}
    want = set()
    for w in read - set(true):
        costs = {t: total_cost(t, w) for t in true}
        least = min(costs.values())
        if least <= (0.41 if len(w) <= 4 else 0.81):
            want |= {(w, t) for t, c in costs.items() if c < least + 0.01}
    assert got - want == want - got == set() and ("rninirnurn", "minimum") in got and ("cornrnitrnent", "commitment") in got


def test_running_headers_are_learned(spark):
    heads = ["Annual Report 2023", "Internal use only"]
    kinds = ["metal", "grain", "river", "lamp", "tower", "mast", "corner", "plan"]
    texts = [f"we built the {a} line\n{heads[i % 2]}\nfor clients of the {b} house" for i, (a, b) in enumerate(zip(kinds, reversed(kinds)))]
    texts += [f"we built the {a}\nMetal line and\nthe {b} house" for a, b in zip(kinds, reversed(kinds))] + ["the metal line and the house, the grain metal works", "and the river metal line"]
    texts += [f"the {a} metal line" for a in kinds]
    got = scanned(spark, texts)
    assert all(got[i].damage == ["page_line"] and heads[i % 2] not in got[i].repaired for i in range(8))
    assert all(got[i].damage == [] for i in range(8, len(texts)))


def test_joined_repairs_equal_broadcast_ones(spark, small):
    from unifold.llm.records import profile_texts

    df = profile_texts(spark.read.parquet(f"{small}/output_default.parquet"))
    a, b = ({tuple(map(str, r)) for r in inspect_texts(df, table_rows=n).collect()} for n in (300_000, 0))
    assert a == b and any("wrong_char" in r[-1] for r in a)


def test_scanned_empty_table(spark):
    assert inspect_texts(spark.createDataFrame([], "text string, n int")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=BUCKETS, max_size=BUCKETS), st.integers(1, 6))
def test_plan_takes_every_length_once(values, sparse):
    h = np.array([0, *[v if i % sparse == 0 else 0 for i, v in enumerate(values)]], np.int64)[: 64 + 1]
    used = np.zeros_like(h)
    for pattern, times in plan(h, 64, 3):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            used[k] += n * times
    assert (used == h).all()


def test_plan_is_tight():
    r = np.random.default_rng(2)
    h = np.bincount(np.minimum(BUCKETS, r.geometric(0.01, 20_000)), minlength=BUCKETS + 1)
    h[0] = 0
    used = sum(times for _, times in plan(h))
    assert used <= 1.01 * -(-(h * np.arange(BUCKETS + 1)).sum() // BUCKETS) + 1
    assert fullest(np.array([0, 5, 0, 1]), 3)[3] == 1


def test_packing(spark, small):
    docs = spark.createDataFrame([(1, "", "c"), (2, None, "c"), (3, "word " * 9000, "c"), (4, "a", "c"), (4, "a", "c"), (None, "a", "c")], "doc_id bigint, text string, container_no string")
    out = pack(item_sizes(docs)).collect()
    assert sorted((r.doc_id, r.part_no) for r in out) == [(1, 0), (3, 0), (3, 1), (3, 2), (3, 3), (3, 4), (4, 0), (4, 0)]
    assert sum(r.n_tokens for r in out if r.doc_id == 3) == count("word " * 9000)
    assert pack(item_sizes(docs.limit(0))).count() == 0
    whole = pack(item_sizes(spark.read.parquet(f"{small}/documents.parquet").repartition(3)).withColumn("rank", F.lit("clash")))
    assert whole.groupBy("container_no").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0
    assert whole.dropDuplicates(["doc_id", "part_no"]).count() == whole.count()


PIECES = st.lists(st.sampled_from(["# Title\n", "Some words here. And there! ", "- item one\n", "\n\n", "日本語の文章。", "é", "😀😀", "x" * 300, "\t", "KEY PART\n", "a,b;c "]), max_size=60)


@settings(max_examples=60, deadline=None)
@given(PIECES, st.sampled_from([(16, 0), (24, 8), (64, 16)]))
def test_pieces_cover_the_text(parts, sizes):
    text, (limit, overlap) = "".join(parts), sizes
    got = split_text(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][2] == len(text)
    assert all(a[2] == b[0] and b[1] <= b[0] for a, b in zip(got, got[1:]))
    for b, ob, e, n in got:
        assert n == count(text[ob:e]) <= limit and (len(got) == 1 or e > b)


def test_cuts_fall_on_structure():
    text = "# One\n" + "alpha beta gamma. " * 6 + "\n\n# Two\n" + "delta epsilon. " * 6 + "\n"
    cuts = [text[b:e] for b, e in split_core(text, 40, boundaries(text))]
    assert [c.startswith("#") for c in cuts] == [True, True]
    first = split_text("word " * 400, 64, 16)
    assert all(count(("word " * 400)[ob:b]) == 16 for b, ob, _, _ in first[1:])


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "short", 0), (2, None, 0), (3, "", 0), (4, "para one. " * 400, 0), (5, "z9" * 20_000, 0), (None, "w " * 900, 0)], "doc_id bigint, text string, piece int")
    got = split_documents(df).collect()
    assert {r.doc_id for r in got} == {4, 5} and max(r.n_tokens for r in got) <= 512
    assert split_documents(df.limit(0)).count() == 0


def naive(doc, item, m, k):
    d, w = words(doc), words(item)
    for n in range(m, len(w) + 1):
        for i in range(len(w) - n + 1):
            for j in range(len(d) - n + 1):
                if sum(a != b for a, b in zip(w[i : i + n], d[j : j + n])) <= n // k:
                    return True
    return False


def test_leaks_equal_brute_force(spark):
    r = random.Random(11)
    items = [(i, " ".join(passage(r, r.randrange(10, 45)))) for i in range(25)]
    docs = []
    for d in range(150):
        text = passage(r, r.randrange(0, 60))
        if d % 2:
            w = items[r.randrange(25)][1].split()
            a = r.randrange(max(1, len(w) - 12))
            part = w[a : a + r.randrange(14, 45)]
            for at in r.sample(range(len(part)), min(len(part), r.randrange(0, 5))):
                part[at] = r.choice(VOCAB)
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((d, r.choice([" ", "\n", " <b>", ", "]).join(text).upper() if d % 3 else " ".join(text)))
    want = {(d, i) for d, t in docs for i, s in items if naive(t, s, 20, 8)}
    dd = spark.createDataFrame([(*x, 1) for x in docs] + [(900, None, 1), (901, "", 1), (None, items[0][1], 1), docs[1] + (1,)], "doc_id bigint, text string, item_id int")
    ii = spark.createDataFrame([*items, items[0], (77, None), (78, ""), (None, "x")], "item_id bigint, text string")
    assert want and {tuple(x) for x in find_leaks(dd, ii).collect()} == want
    assert {tuple(x) for x in find_leaks(dd, ii, block_chars=1500).collect()} == want  # in blocks
    assert find_leaks(dd.limit(0), ii).count() == 0 and find_leaks(dd, ii.limit(0)).count() == 0


def test_exchanged_words_of_any_length(spark):
    """A long word in the place of a short one moves the rest to other diagonals."""
    r = random.Random(7)
    items, docs = [], []
    for i in range(210):
        w = [f"{r.choice('abcdefghij')}{r.randrange(10**5)}" for _ in range(20)]
        items.append((i, " ".join(w)))
        for k in r.sample(range(20), 2):
            w[k] = "z" * (1, 8, 20, 40, 60, 90, 900)[i % 7]
        docs.append((i, "lead in " + " ".join(w) + " way out"))
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(x) for x in find_leaks(dd, ii).collect()} == {(i, i) for i in range(210)}


def test_divided_words_and_long_texts(spark):
    r = random.Random(4)
    w = passage(r, 30)
    item = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    cut = " ".join(w[:10]) + " " + w[10][:3] + "-\n" + w[10][3:] + " " + " ".join(w[11:25])
    filler = " ".join(passage(r, 30_000))
    docs = spark.createDataFrame([(1, cut), (2, f"{filler} {' '.join(w[3:24])} {filler}"), (3, filler), (4, "q" * 300_000)], "doc_id bigint, text string")
    assert {x.doc_id for x in find_leaks(docs, item).collect()} == {1, 2}
    assert build_index([], 20, 8).ids == []
