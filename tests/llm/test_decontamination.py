import random

import numpy as np

from ambry.llm.decontamination import Index, budget, contaminated, edits, normalised, windows, without_contaminated


def nearest(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(n))


def changed(draw, text, times):
    out = list(text)
    for _ in range(times):
        at = draw.randrange(len(out))
        kind = draw.random()
        if kind < 0.4:
            out[at] = draw.choice("xyz ")
        elif kind < 0.7:
            out.insert(at, draw.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def test_regions_within_the_budget_are_all_found_with_their_edits():
    draw = random.Random(5)
    items = [(k, words(draw, draw.randrange(12, 50))) for k in range(30)]
    index = Index.of(items)
    near = far = 0
    for _ in range(250):
        item, pattern = draw.choice(items)
        text = f"{words(draw, 40)}. {changed(draw, pattern, draw.randrange(0, len(pattern) // 6)).upper()}! {words(draw, 40)}"
        p, t = normalised(pattern)[0], normalised(text)[0]
        true = nearest(p.tolist(), t.tolist())
        found = [h for h in index.find(text) if h[0] == item]
        assert bool(found) == (true <= budget(p.size))
        if found:
            assert min(h[1] for h in found) == true
            near += 1
        else:
            far += 1
    assert near > 50 and far > 20


def test_banded_alignment_names_the_region():
    p, t = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in ("abcdefgh", "zzzabcxdefghzz"))
    assert edits(p, t, 6, 2) == (1, 3, 12)
    assert edits(p, t, 6, 0) is None


def test_case_marks_and_spaces_do_not_matter_and_places_are_those_of_the_text():
    index = Index.of([(4, "The quick, brown fox jumps over the lazy dog!")])
    text = "  Well: THE  QUICK brown\nfox jumps -- over the lazy dog. End"
    (item, cost, start, end), = index.find(text)
    assert (item, cost) == (4, 0)
    assert text[start:end] == "THE  QUICK brown\nfox jumps -- over the lazy dog"


def test_repeating_texts_and_long_items():
    draw = random.Random(2)
    item = words(draw, 900)
    codes, _ = normalised(item)
    assert len(list(windows(codes))) > 10
    index = Index.of([(1, item), (2, None), (3, ""), (4, "short")])
    assert not index.find("the the " * 4000)
    assert {h[0] for h in index.find("x " + item[1000:2200] + " y")} == {1}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the same text twice word for word"), (2, None), (None, "x" * 30), (3, "")], "item_id long, text string")
    got = contaminated(odd, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == [(6, 1, 0), (6, 1, 0), (7, 1, 0)]
    kept = without_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert contaminated(none, bench).count() == 0
    assert contaminated(odd, bench.limit(0)).count() == 0
    assert without_contaminated(odd, bench.limit(0)).count() == odd.count()
