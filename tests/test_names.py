"""Names: similarity, clusters, merges, against brute force where it matters."""

import random

from pyspark.sql import functions as F

from ambry.functions import names as N
from ambry.functions.stem import stem
from ambry.functions.text import slugify
from ambry.operators import labelling, matching, merging, similar


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def ratio(a, b):
    longest = max(len(a), len(b))
    return 1.0 if longest == 0 else 1 - lev(a, b) / longest


def brute_pairs(names, threshold):
    key = lambda n: (n, " ".join(sorted(set(n.split()))))
    return {
        (a, b)
        for a in names for b in names
        if a < b and max(ratio(x, y) for x, y in zip(key(a), key(b))) >= threshold - 1e-9
    }


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    names = set()
    for _ in range(60):
        base = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3)))
        names.add(base)
        for _ in range(3):
            chars = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(chars))
                what = rng.random()
                if what < 0.4:
                    chars[at] = rng.choice("abc")
                elif what < 0.7:
                    chars.insert(at, rng.choice("abc"))
                elif len(chars) > 1:
                    del chars[at]
            names.add(" ".join("".join(chars).split()) or "a")
    # single letters a..c hold no roman numerals, so all signatures are equal
    rows = spark.createDataFrame([(n, 1) for n in names], "name string, count long")
    for threshold in (0.88, 0.7):
        got = {(r.a, r.b) for r in similar.similar_pairs(rows, threshold).collect()}
        assert got == brute_pairs(names, threshold)


def clusters(frame, rows):
    found = similar.cluster_names(frame(rows, "name string, count long")).collect()
    out = {}
    for r in found:
        out.setdefault((r.head, r.cluster_count), set()).add(r.name)
    return out


def test_typo_merges_and_the_frequent_spelling_leads(frame):
    got = clusters(frame, [("Vida Cristã", 2), ("Vida Crista", 9), ("Outra coisa", 1)])
    assert got == {("Vida Crista", 11): {"Vida Cristã", "Vida Crista"}, ("Outra coisa", 1): {"Outra coisa"}}


def test_different_numbers_never_merge(frame):
    assert len(clusters(frame, [("CFW 12", 1), ("CFW 13", 1), ("Livro II", 1), ("Livro III", 1)])) == 4


def test_clusters_are_transitive(frame):
    rows = [("abcdefghij", 1), ("abcdefghix", 1), ("abcdefghyx", 1)]
    assert list(clusters(frame, rows).values()) == [{n for n, _ in rows}]


def test_components_of_a_long_chain_and_a_star(frame):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    star = [("s000", f"s{i:03}") for i in range(1, 80)]
    got = {r.node: r.root for r in similar.components(frame(chain + star, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "s000"} and len(got) == 61 + 80


def test_digit_signature(frame):
    rows = frame([("CFW 07 parte II",), ("Sem nada",), ("tomo 10",)], "name string")
    assert [r[0] for r in rows.select(N.digit_signature(F.col("name"))).collect()] == ["7,2", "", "10"]


def test_honorifics(frame):
    title, name = N.split_honorific(F.col("p"))
    rows = frame([("Pastor Ana Lima",), ("Ana Lima",), ("Presbitero X",)], "p string").select(title, name)
    assert [tuple(r) for r in rows.collect()] == [("Pastor", "Ana Lima"), ("Outros", "Ana Lima"), ("Presbitero", "X")]


def test_slugify_is_idempotent(frame):
    once = frame([("  1ª Coríntios — Ção! ",)], "t string").select(slugify(F.col("t")).alias("s"))
    assert once.first()[0] == "1-corintios-cao" == once.select(slugify(F.col("s"))).first()[0]


def test_follow_stops_at_unknown_targets_and_in_cycles(frame):
    links = frame([(1, 2), (2, 3), (3, None), (4, 99), (5, 6), (6, 5)], "id long, merge_into long")
    got = {r.id: r.root for r in merging.follow(links).collect()}
    # nine steps round a cycle of two end on the other node
    assert got == {1: 3, 2: 3, 3: 3, 4: 4, 5: 6, 6: 5}


def test_collections_merge_and_keep_published_slugs(frame):
    clusters = frame([(0, "Vida", 5), (1, "A Vida", 2), (2, "CFW 3", 1)], "id long, head string, count long")
    decisions = frame(
        [(0, "Vida", "d", "O Curso", None), (1, "Vida", "", None, 0), (2, "Curso", "", None, None)],
        "id long, name string, description string, parent string, merge_into long",
    )
    prior = frame([(0, "vida-antiga")], "id long, prior string")
    rows = {r.slug: r for r in merging.build_collections(clusters, decisions, prior).collect()}
    assert rows["vida-antiga"].total == 7 and rows["vida-antiga"].parent_slug == "curso"
    assert rows["curso"].kind == "cfw"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_ratio_equals_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        want = 100.0 if not a + b else 200 * brute_lcs(a, b) / (len(a) + len(b))
        assert abs(matching.indel_ratio(a, b) - want) < 1e-9


def test_nearest_names_equal_all_pairs(frame):
    rng = random.Random(5)
    drawn = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14)))
    names = ["joao silvaa", "maria", "zzzz", "", *(drawn() for _ in range(150))]
    entries = ["joao silva", "maria", "maria ", "joao", "maria", "", *(drawn() for _ in range(60))]
    want = {}
    for name in names:
        found = [(-matching.indel_ratio(name, e), i, e) for i, e in enumerate(entries)]
        score, _, entry = min(found)
        if score <= -70:
            want[name] = (entry, -score)
    got = matching.nearest_names(frame([(n,) for n in [*names, None]], "name string"), frame(
        [*enumerate(entries), (99, None)], "entry_pos long, entry string"
    )).collect()
    assert {r.name: (r.match, r.score) for r in got} == want
    assert want["joao silvaa"][0] == "joao silva" and want["maria"][0] == "maria" and "zzzz" not in want


def test_people_from_descriptions(frame):
    records = frame(
        [(1, "Estudo por Pr. Joao Silva\nresto", None), (2, "nada", "Rev. Maria"), (3, "por ninguem", None),
         (4, "Mesa por xyzw qqqq, Seminarista Maria e outro", None)],
        "id long, description string, credited string",
    )
    entries = frame([(0, "joao silva", "João da Silva"), (1, "maria", "Maria Souza")], "entry_pos long, entry string, full_name string")
    got = {r.id: r.person for r in matching.resolve_people(records, entries).collect()}
    assert got == {1: "João da Silva", 2: "Maria Souza", 3: None, 4: "Maria Souza"}


def test_first_containing_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(50)]
    texts += [(100, "the common boilerplate of every text here"), (101, "x the common boilerplate of every text here too")]
    needles = []
    for i in range(60):
        source = rng.choice(texts)[1]
        at = rng.randrange(len(source))
        needles.append((i, source[at:at + rng.randint(1, 60)].upper() if i % 4 else word() + "q"))
    want = {}
    for i, n in needles:
        hits = [p for p, t in texts if n.lower() in t]
        if hits and n:
            want[i] = min(hits)
    got = matching.first_containing(
        spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "pos long, text string")
    )
    assert {r.needle_id: r.pos for r in got.collect()} == want


def test_stems_of_published_examples(frame):
    # word and stem as the public sample vocabulary of the algorithm has them, plain spellings only
    want = {
        "boa": "boa", "boas": "boas", "boato": "boat", "boatos": "boat", "boca": "boc", "bocado": "boc",
        "boiada": "boi", "boicote": "boicot", "bolinhas": "bolinh", "quieto": "quiet", "quilos": "quil",
        "quintas": "quint", "felizmente": "feliz", "antigamente": "antig", "cantava": "cant",
    }
    got = {r.word: r.stem for r in stem(frame([(w,) for w in want], "word string")).collect()}
    assert {w: got[w] for w in want} == want


def test_slugs_are_taken_in_order(frame):
    rng = random.Random(2)
    topics = ["Foo", "Foo", "Foo 2", "foo", "Foo-2-2", "Bar", "foo 3", "Foo 2", "bar 2", "Bar"]
    topics += [rng.choice(["a", "a 2", "a-2-2", "a 3", "b", "a 2 3"]) for _ in range(60)]
    want, used = {}, set()
    for pos, topic in enumerate(topics):
        base = topic.lower().replace(" ", "-")
        k = 1
        while (slug := base if k == 1 else f"{base}-{k}") in used:
            k += 1
        used.add(slug)
        want[pos] = slug
    rows = frame([(i, f"g{i}", t) for i, t in enumerate(topics)], "pos long, group string, topic string")
    assert {r.pos: r.topic_slug for r in labelling.taxonomy_rows(rows).collect()} == want
