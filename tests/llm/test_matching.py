"""Reference lists, names and people."""

import random

import numpy as np

from unifold.llm.linkage import admm, firm_key, ground, link_people
from unifold.llm import linkage, namelinks
from unifold.llm.metric import BKTree, distances, encode, levenshtein, pair_distances, typing_cost, typing_costs
from unifold.llm.namelinks import linked_names
from unifold.llm.personnames import GivenNames, readings, without_umlauts
from unifold.llm.refmap import Matcher, map_values, reference_entries


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_batched_distances():
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcé") for _ in range(n))
    for p in [word(r.randrange(0, 12)) for _ in range(20)] + [word(64), word(70)]:
        many = [word(r.randrange(0, 15)) for _ in range(30)] + [word(90)]
        assert distances(p, *encode(many)).tolist() == [plain(p, m) for m in many]


def test_pairwise_distances():
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcé") for _ in range(n))
    for lengths in (range(0, 14), range(0, 80)):
        pairs = [(word(r.choice(lengths)), word(r.choice(lengths))) for _ in range(60)] + [("", ""), ("", "ab"), ("ab", "")]
        assert pair_distances(*map(list, zip(*pairs))).tolist() == [plain(a, b) for a, b in pairs]
    assert len(pair_distances([], [])) == 0


def test_bk_tree_finds_all_within():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 9)))
    entries, asked = [word() for _ in range(120)], [word() for _ in range(60)]
    got = BKTree(entries).within(asked, np.array([i % 4 for i in range(60)]))
    for i, (q, found) in enumerate(zip(asked, got)):
        assert sorted(found) == sorted({e for e in entries if levenshtein(q, e) <= i % 4})
    assert BKTree([]).within(["a"], np.array([1])) == [[]]


def test_slips():
    assert typing_cost("ab", "ba")[0] == typing_cost("abb", "ab")[0] == 1 and typing_cost("", "abc")[0] == 3
    assert typing_cost("austrlia", "australia") < typing_cost("austrlia", "austria")


REF = [(1, "country", "Niger", []), (2, "country", "Nigeria", ["NG"]), (3, "title", "Data Analyst", []), (4, "title", "Senior Data Analyst", []), (5, "skill", "C++", ["cpp"]), (6, "skill", "C", []), (7, "skill", "Go", ["golang"]), (8, "title", "Site Reliability Engineer", ["sre"]), (None, "title", "Ghost", []), (9, None, "Ghost", [])]
VALUES = [("country", "nigeira", 2), ("country", "N.G.", 2), ("country", " (Niger) ", 1), ("title", "Analyst, Data", 3), ("title", "Sr. Data Anlst", 4), ("title", "SeniorDataAnalyst / part-time", 4), ("title", "Site Reliab. Engr", 8), ("title", "Data Sculptor", -1), ("skill", "• C", 6), ("skill", "C++ (basic)", 5), ("skill", "Godot", -1), ("skill", "go - 5 yrs", 7), ("skill", None, -1), ("skill", " ", -1), ("planet", "Mars", -1), ("skill", "C++ (" + "x" * 3000 + ")", 5), ("skill", "  Golang" + " " * 900 + "- 3 years", 7), ("skill", "c" * 5000, -1)]


def test_reference_values(spark):
    ref = spark.createDataFrame([(*r, 0) for r in REF], "ref_id bigint, ref_kind string, canonical string, aliases array<string>, cost int")
    df = spark.createDataFrame([(i, k, v, "clash") for i, (k, v, _) in enumerate(VALUES)], "n int, kind string, value string, ref_id string")
    for size in (10**6, 60):
        got = {r.n: r.ref_id for r in map_values(df, ref, size).collect()}
        assert [got[i] for i in range(len(VALUES))] == [w for *_, w in VALUES]
    assert map_values(df.limit(0), ref).count() == 0
    assert {r.ref_id for r in map_values(df, ref.limit(0)).collect()} == {-1}


def test_tree_and_scan_agree():
    m = Matcher(reference_entries([(i, "".join(random.Random(i).choice("abcdefgh") for _ in range(9)), None) for i in range(80)]))
    asked = ["".join(random.Random(900 + i).choice("abcdefgh") for _ in range(9)) for i in range(50)] + [e[:4] + e[5:] for e in list(m.entries)[:40]]
    for value, (level, _, _, edits, _, ref) in zip(asked, m.match(asked)):
        assert level != 0 or edits == 0
        nearest = min(typing_cost(value, e)[0] for e in m.entries)
        assert (ref >= 0) == (nearest <= 2) and (ref < 0 or edits == nearest)


def test_shards_change_nothing(spark):
    """Equal rows with one, two and many shards; repeated rows stay."""
    r = random.Random(8)
    words = ["data", "analyst", "senior", "cloud", "engineer", "lead", "ops"]
    entries = [" ".join(r.sample(words, r.choice((1, 2, 3)))) for _ in range(40)] + ["analyst data", "Data Analyst"]
    ref = spark.createDataFrame([(i, "title", e, [" ".join(r.sample(words, 2))] if i % 5 == 0 else None) for i, e in enumerate(entries)], "ref_id bigint, ref_kind string, canonical string, aliases array<string>")
    asked = ["Data Analyst", "Data Analyst", None, " "] + [" ".join(r.sample(words, r.choice((1, 2, 3)))).replace("a", "", r.choice((0, 1))) for _ in range(80)] * 2
    df = spark.createDataFrame([("title" if i % 40 else None, v, 1) for i, v in enumerate(asked)], "kind string, value string, n int")
    total = 10**4
    one, two, many = (sorted(map(str, map_values(df, ref, size).collect())) for size in (total, 900, 120))
    assert one == two == many and len(one) == len(asked)


def test_readings():
    g = GivenNames()
    one = lambda n: {(r.pivot, r.family, r.initial_only) for r in readings(n, g)}
    assert one("Stone, Frederick") == one("FREDDIE STONE") == one("Dr. Stone Frederick Jr.") == one("Fredrick  de Stone (they/them)") == {("frederick", "stone", False)}
    assert one("F. Stone") == one("Stone F") == {("i:f", "stone", True)}
    assert one("n/a") == one(None) == one("Stone") == one("  ") == set()


def test_linked_names(spark):
    names = ["Frederick Stone", "Stone, Fred", "FREDERICK STONNE", "F. Stone", "Fredrick Stone", "Margaret Stone", "Peggy Stone", "Jürgen Hölmark", "Juergen Hoelmark", "n/a", "Prince", "Frederick Overmill", "Zyx Quorl", "Quorl Zyx", " Frederick Stone ", None, "", "x" * 5000]
    df = spark.createDataFrame([(n.strip() if n else n,) for n in names], "name string").where("name <> ''").distinct()
    got = {tuple(r) for r in linked_names(df).collect()}
    groups = [["Frederick Stone", "Stone, Fred", "FREDERICK STONNE", "F. Stone", "Fredrick Stone"], ["Margaret Stone", "Peggy Stone"], ["Jürgen Hölmark", "Juergen Hoelmark"], ["Zyx Quorl", "Quorl Zyx"]]
    assert got == {tuple(sorted((a, b))) for g in groups for a in g for b in g if a < b}
    assert linked_names(df.limit(0)).count() == 0


def test_admm_finds_the_minimum():
    pots = [((0,), (-1.0,), 1.0, 1.0), ((0,), (1.0,), 0.0, 3.0), ((1,), (-1.0,), 1.0, 2.0), ((0, 1), (1.0, 1.0), -1.0, 0.5)]
    got = admm(2, pots, rounds=500)

    def loss(x, y):
        return max(0, 1 - x) ** 2 + 3 * x**2 + 2 * max(0, 1 - y) ** 2 + 0.5 * max(0, x + y - 1) ** 2

    grid = [i / 200 for i in range(201)]
    best = min((loss(x, y), x, y) for x in grid for y in grid)
    assert abs(loss(*got) - best[0]) < 1e-3 and len(admm(0, [])) == 0


def test_ground_network():
    node = lambda c, towns=(), firms=0: {"comp": c, "towns": list(towns), "firms": firms, "phones": 0, "handles": 0}
    variables, pots = ground([node(3, ["a"], 1), node(1), node(2, ["b"], 1)])
    y = dict(zip(variables, admm(len(variables), pots)))
    assert set(variables) == {(2, 1), (3, 1), (3, 2)} and y[3, 2] < 0.5


def people(spark, sheet, hosts, profiles):
    s = spark.createDataFrame(sheet, "csv_row_id bigint, name string, email string, phone string, current_company string, record_no string")
    h = spark.createDataFrame(hosts, "profile_id bigint, user_profile struct<login:string,name:string,email:string,bio:string,location:string>")
    p = spark.createDataFrame(profiles, "record_no bigint, full_name string, emails array<string>, phones array<string>, links struct<github:string>, experience array<struct<company:string>>, location struct<city:string>")
    return s, h, p


def test_link_people(spark):
    sheet = [
        (1, "Fred Stone", "fred@x.example", None, None, "clash"), (2, "Stone, Frederick", None, None, "Northmill Ltd", ""), (3, None, "fred@x.example", None, None, ""), (4, "Margaret Stone", None, "+1 200 555 0100", None, ""),
        (5, None, None, None, None, ""), (6, "n/a", "", "call later", "", ""), (None, "Fred Stone", "fred@x.example", None, None, ""), (1, "Fred Stone", "fred@x.example", None, None, "clash"),
    ]
    hosts = [(1, ("fstone", "Frederick Stone", None, "Engineer @ Northmill", "Lake City, X")), (2, None), (3, ("other", None, None, None, None))]
    profiles = [
        (10, "Frederick Stone", ["Fred@X.example "], ["+12005550100"], None, [("Northmill Systems",)], ("Lake City",)), (11, "FREDERICK STONE", None, None, ("https://h.example/fstone",), None, None),
        (12, "Margaret Stone", [], ["200-555-0100"], None, None, None), (13, None, None, None, None, None, None), (14, "Frederick Stone", ["b@y.example"], ["+12005559999"], None, [("Hillgate",)], ("Far Town",)),
    ]
    s, h, p = people(spark, sheet, hosts, profiles)
    rows = link_people(s, h, p).collect()
    got = {(r.src_table, r.src_id, r.record_no) for r in rows}
    fred = {("sample_csv", 1), ("sample_csv", 2), ("sample_csv", 3), ("github_mock", 1)}
    assert got == {(*f, r) for f in fred for r in (10, 11)} | {("sample_csv", 4, 12)}
    assert len(rows) == len(got) and all(0.5 < r.confidence <= 1 for r in rows)
    assert link_people(s.limit(0), h.limit(0), p.limit(0)).count() == 0 and link_people(s, h.limit(0), p).count() > 0


def test_firm_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Northmill Systems GmbH",), ("NORTHMILL",), ("Group",), (" ",), (None,)], "f string")
    assert [r[0] for r in df.select(firm_key(F.col("f"))).collect()] == ["northmill", "northmill", "group", None, None]


def test_large_names_follow_the_same_rule(spark):
    """Two components of one town are joined whatever the number of others; one that fits all is joined to none."""
    from unifold.llm.linkage import Network, soft_matches

    schema = "who string, comp bigint, towns array<string>, firms int, phones int, handles int"
    for k in (4, 9, 50, 500):
        nodes = [("x", 1, ["a"], 1, 0, 0), ("x", 2, ["a"], 2, 0, 0), ("x", 3, [], 0, 0, 0)] + [("x", c, [f"t{c}"], 1, 0, 0) for c in range(4, k + 1)]
        got = {r.comp: r.person for r in soft_matches(spark.createDataFrame(nodes, schema)).collect()}
        assert got == {1: 1, 2: 1}, k
    # Kinds with counts have the minimum of the network of all components.
    nodes = [{"comp": c, "towns": [t] if t else [], "firms": f, "phones": 0, "handles": 0} for c, (t, f) in enumerate([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("", 0), ("", 0), ("e", 0)])]
    pairs, pots = ground(nodes)
    each = dict(zip(pairs, admm(len(pairs), pots, rounds=20_000)))
    net = Network([x | {"n": 1 + (i == 5)} for i, x in enumerate(nodes) if i != 6])
    while net.add(net.broken(y := admm(len(net.pairs), net.pots, counts=net.counts))):
        pass
    assert len(net.pairs) < len(pairs) and sum(map(net._count, net.pairs)) == len(pairs)
    assert abs(y[net.at[0, 1]] - each[1, 0]) < 2e-3 and abs(y[net.at[5, 5]] - each[6, 5]) < 2e-3 and abs(y[net.at[0, 5]] - each[5, 0]) < 2e-3


def linked(spark, names):
    return {tuple(r) for r in linked_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}


def test_initials_with_many_meanings(spark):
    names = ["James Stone", "Joseph Stone", "Jonathan Stone", "Johannes Stone", "J. Stone", "Stone, J."]
    assert linked(spark, names) == {tuple(sorted((a, b))) for a in names[4:] for b in names if a != b}


def test_repeated_misspellings(spark):
    right = ["Robert Schwarzenberger", "Schwarzenberger, Robert", "Bob Schwarzenberger"]
    wrong = ["Robert Schwarzenbregre", "Schwarzenbregre, Robert"]
    every = right + wrong
    assert linked(spark, every) == {(a, b) for a in every for b in every if a < b}


def test_rare_given_names(spark):
    """Slips and initials of given names that no table and no learning knows."""
    names = ["Quirin Hofer", "Hofer, Quirrin", "Q. Hofer", "Quirin Hoffer", "Quirrin Hofer", "Quirin Maier"]
    assert linked(spark, names) == {tuple(sorted((a, b))) for a in names[:5] for b in names[:5] if a != b}


def test_long_names(spark):
    middle = " ".join(f"Mid{chr(97 + i)}" for i in range(12))
    a, b = f"Robert {middle} Overmill", "Bob Overmill"
    assert linked(spark, [a, b, "w " * 3000]) == {tuple(sorted((a, b)))}


def test_split_cells_change_nothing(spark, monkeypatch):
    from unifold.llm import namelinks

    r = random.Random(4)
    family = lambda: "".join(r.choice("abdeilnorst") for _ in range(r.choice((6, 7, 9, 10))))
    names = []
    for _ in range(60):
        f = family()
        k = r.randrange(len(f))
        names += [f"Robert {f}", f"{f}, Bob", f"Rob {f[:k] + f[k + 1 :]}", f"R. {f}"]
    whole = linked(spark, names)
    monkeypatch.setattr(namelinks, "CELL", 7)
    assert linked(spark, names) == whole and len(whole) > 200


def test_confidences_do_not_depend_on_partitions(spark):
    from unifold.llm.linkage import soft_matches

    r = random.Random(12)
    nodes = [(f"n{i % 90}", i, r.sample(["a", "b", "c", "d"], r.choice((0, 1, 1, 2))), r.randrange(2), r.randrange(2), r.randrange(2)) for i in range(500)]
    df = spark.createDataFrame(nodes, "who string, comp bigint, towns array<string>, firms int, phones int, handles int")
    one, many = (sorted(map(tuple, soft_matches(df.repartition(n)).collect())) for n in (1, 37))
    assert one == many and len(one) > 50
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted(map(tuple, soft_matches(df).collect())) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batched_slips():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(0, 10)))
    pairs = [(word(), word()) for _ in range(400)]
    edits, cost = typing_costs(*map(list, zip(*pairs)))
    assert [(e, c / 10) for e, c in zip(edits.tolist(), cost.tolist())] == [(e, round(c, 1)) for e, c in (typing_cost(a, b) for a, b in pairs)]
    assert [len(x) for x in typing_costs([], [])] == [0, 0]


def test_cells_compare_few_pairs(monkeypatch):
    """Originals as by comparing all pairs, from pairs that grow with the names of a cell; long words and several shares included."""
    r = random.Random(8)
    names = {"".join(r.choice(["bra", "ko", "li", "mue", "nor", "pa", "qui", "ste", "tha", "vu"]) for _ in range(r.randrange(3, 6))) for _ in range(1500)} | {"x" + "ab" * 30}
    for x in sorted(names)[::3]:
        at = r.randrange(len(x) - 1)
        names |= {x[:at] + x[at + 1 :], x[:at] + x[at + 1] + x[at] + x[at + 2 :]}
    ordered = sorted(((r.choice([1, 1, 2, 3, 9]), x) for x in names), key=lambda p: (-p[0], p[1]))
    n, words = np.array([k for k, _ in ordered]), [x for _, x in ordered]
    seen = []
    monkeypatch.setattr(namelinks, "typing_costs", lambda a, b: seen.append(len(a)) or typing_costs(a, b))
    starts = np.array([0, 700])
    got = namelinks._parents(words, n, np.ones(len(words), bool), starts)
    assert sum(seen) < 0.1 * sum(k * k / 2 for k in (700, len(words) - 700))
    for i in r.sample(range(len(words)), 150):
        lo, x, reach = 0 if i < 700 else 700, words[i], 2 if len(words[i]) >= 8 else 1
        umlaut = [y for y in words[lo:i] if without_umlauts(y) == without_umlauts(x)]
        near = [(*typing_cost(x, words[j]), j) for j in range(lo, i) if n[j] >= 2 * (n[i] - 1) and abs(len(words[j]) - len(x)) <= reach]
        near = [(e, -n[j], round(10 * c), words[j]) for e, c, j in near if e <= reach]
        assert got[i] == (umlaut[0] if umlaut else min(near)[3] if near else x)
    monkeypatch.setattr(namelinks, "FORMS", 20_000)
    monkeypatch.setattr(namelinks, "BLOCK", 1000)
    assert namelinks._parents(words, n, np.ones(len(words), bool), starts) == got


def test_ties_of_a_name_are_closed_together(spark, monkeypatch):
    """Components as by a search over all ties, whatever rows are tied together."""
    r = random.Random(9)
    rows, meant = [], []
    for i in range(400):
        keys = [f"{kind}:{r.randrange(900)}" for kind in "ephs" if r.random() < 0.4]
        rows.append((i, keys, [f"f{r.randrange(40)}"] if r.random() < 0.3 else [], [f"t{r.randrange(3)}"]))
        meant += [(i, w) for w in r.sample([f"w{k}" for k in range(25)], r.choice((0, 1, 1, 1, 2)))]
    people = spark.createDataFrame(rows + rows[:20], "mid bigint, keys array<string>, firms array<string>, towns array<string>")
    names = spark.createDataFrame(meant, "mid bigint, who string")
    whos, ties, owners = {}, {}, {}
    for i, w in meant:
        whos.setdefault(i, []).append(w)
    proofs = {i: [k for k in keys if k[0] in "eh"] + [f"x|{k}|{f}" for k in keys if k[0] == "p" for f in firms] for i, keys, firms, _ in rows}
    for i, keys, firms, _ in rows:
        for w in whos.get(i, []):
            for k in [*keys, *(f"f:{f}" for f in firms), *proofs[i]]:
                ties.setdefault((k, w), set()).add(i)
            for k in proofs[i]:
                owners.setdefault(k, set()).add(w)
    for i, proof in proofs.items():
        for k in [] if i in whos else proof:
            if len(owners.get(k, ())) < 2:
                ties.setdefault((k, *owners.get(k, ())), set()).add(i)
    comp = {i: i for i, *_ in rows}
    for _ in rows:
        for held in ties.values():
            low = min(comp[i] for i in held)
            comp |= {i: low for i in held}
    for together in (100_000, 3):
        monkeypatch.setattr(linkage, "TOGETHER", together)
        comps, found = linkage.tie_mentions(people, names)
        got = comps.collect()
        assert len({x.mid for x in got}) == len(got) and {x.mid: x.comp for x in got} == {x.mid: comp[x.mid] for x in got}
        assert {i for i in comp if sum(comp[j] == comp[i] for j in comp) > 1} <= {x.mid for x in got}
        several = {w for _, w in meant if len({comp[i] for i, v in meant if v == w}) > 1}
        assert {x.who for x in found.select("who").collect()} >= several
