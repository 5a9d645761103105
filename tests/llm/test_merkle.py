import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ambry.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def layers(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(all_layers, place):
    """Per level (left, right) of the path from a leaf."""
    out = []
    for level in all_layers[:-1]:
        run = place // 3 * 3
        out.append((level[run:place], level[place + 1:run + 3]))
        place //= 3
    return out


def by_hand(rows, change):
    """Rows (doc_id, source, lang, n_chars, text) to their results, counted."""
    groups = defaultdict(list)
    for row in rows:
        own = sha("".join(map(field, row)))
        other = sha("".join(map(field, [*row[:4], change(row)])))
        groups[row[1]].append(((row[0] is not None, row[0] or 0), own, other, row[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [layers([g[1] for g in sorted(groups[s])]) for s in order]
    top = layers([t[-1][0] for t in trees])
    out = Counter()
    for number, source in enumerate(order):
        for place, (_, own, other, doc_id) in enumerate(sorted(groups[source])):
            path = siblings(trees[number], place) + siblings(top, number)
            proof = sha("".join("".join(a + b) for a, b in path))
            led = other
            for left, right in path:
                led = sha("".join([*left, led, *right]))
            root = top[-1][0]
            out[doc_id, own, trees[number][-1][0], root, proof, led, led == root] += 1
    return out


def dropped(row):
    return None if row[4] is None else row[4].replace("\n", "") if row[0] is not None and row[0] % 2 else row[4]


def changed():
    return F.when(F.col("doc_id") % 2 == 1, F.translate("text", "\n", "")).otherwise(F.col("text"))


def test_trees_of_many_sizes_against_whole_trees(frame):
    sizes = {None: 4, "a": 1, "b": 3, "é": 28, "c": 9, "z": 82, "": 10}
    rows, doc_id = [], 0
    for source, size in sizes.items():
        for k in range(size):
            doc_id += 1
            rows.append((1000 - doc_id, source, "en", k, f"text {doc_id}\nwith lines" if k % 3 else "plain"))
    docs = frame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    # blocks of three and nine leaves make several storeys out of these trees
    for height in (1, 2):
        got = merkle.manifest(docs, changed(), height=height).collect()
        assert Counter(map(tuple, got)) == by_hand(rows, dropped)
        assert {r.verified for r in got} == {True, False}


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    got = merkle.manifest(odd, changed()).collect()
    assert Counter(map(tuple, got)) == by_hand(rows, dropped)
    assert merkle.manifest(none, changed()).count() == 0


def test_the_accumulator_holds_few_open_subtrees():
    tree = merkle.Accumulator()
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(100)]
    for k, digest in enumerate(digests, 1):
        tree.append(digest)
        assert [len(x) for x in tree.open] == [k // 3**h % 3 for h in range(len(tree.open))]
    root = tree.close(None)
    assert root.hex() == layers([d.hex() for d in digests])[-1][0]
    for digest, above, shape in zip(digests, tree.above, tree.shape, strict=True):
        assert merkle.folded(digest, bytes(above), bytes(shape)) == root
    assert merkle.folded(digests[1], bytes(tree.above[0]), bytes(tree.shape[0])) != root
