import random
import re

from factloom.llm.decontaminate import MASKS, PUNCTUATION, find_all_overlaps, find_overlaps, remove_overlapping


def cut(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower().translate({ord(c): None for c in PUNCTUATION})) if w]


def brute(docs, items, window=13, substitutions=3, least=5):
    out = {}
    for doc_id, text in docs:
        d = cut(text)
        for item_id, body in items:
            w = cut(body)
            if len(w) < least:
                continue
            masks = MASKS if len(w) >= 10 else ("1" * len(w),)
            for mask in masks:
                picked = [k for k, c in enumerate(mask) if c == "1"]
                for i in range(len(d) - len(mask) + 1):
                    for j in range(len(w) - len(mask) + 1):
                        if all(d[i + k] == w[j + k] for k in picked):
                            agree = [0 <= i - j + k < len(d) and d[i - j + k] == x for k, x in enumerate(w)]
                            width = min(window, len(w))
                            best = max(sum(agree[k : k + width]) for k in range(len(w) - width + 1))
                            if best >= width - width * substitutions // window:
                                n, b, t = out.get((doc_id, item_id), (0, 0, 0))
                                out[doc_id, item_id] = n + 1, max(b, best), max(t, sum(agree))
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=n))) for i, n in enumerate([30, 20, 13, 12, 10, 9, 7, 5, 4, 1])] + [(50, None), (51, ""), (52, "same same same same same same same same same same same")]
    docs = []
    for i in range(60):
        body = rnd.choices(vocabulary, k=rnd.randrange(0, 60))
        source = cut(rnd.choice(items[:9])[1])
        for _ in range(rnd.randrange(0, 5)):
            if source:
                source[rnd.randrange(len(source))] = "x"
        at = rnd.randrange(len(body) + 1)
        body[at:at] = [w.upper() + "," if rnd.random() < 0.2 else w for w in source]
        docs.append((i, rnd.choice([" ", "\n", " - "]).join(body)))
    docs += [(100, None), (101, ""), (102, "same " * 40), (103, items[2][1]), (103, items[2][1]), (None, items[0][1])]
    d = spark.createDataFrame([(*r, "x", 3) for r in docs], "doc_id long, text string, item_id string, seed int")
    t = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    expected = brute(docs, items)
    assert len(expected) > 20
    for bound in (1_000_000, 0):
        found = find_overlaps(d, t, broadcast_rows=bound)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    gone = {r[0] for r in expected}
    for bound in (1_000_000, 0):
        left = remove_overlapping(d, found, broadcast_rows=bound).collect()
        assert sorted((r.doc_id for r in left), key=repr) == sorted((i for i, _ in docs if i not in gone), key=repr)


def test_empty_tables(spark):
    d, t = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_overlaps(d, t).collect() == [] and find_overlaps(d.limit(0), t.withColumn("text", t.text)).collect() == []


def plain(docs, items, window=13, substitutions=3):
    """{(doc_id, item_id): (best_window, n_words)} at all shifts, without seeds."""
    out = {}
    for doc_id, text in docs:
        d = cut(text)
        for item_id, body in items:
            w = cut(body)
            width = min(window, len(w))
            for shift in range(-len(w), len(d)) if w else ():
                agree = [0 <= shift + k < len(d) and d[shift + k] == x for k, x in enumerate(w)]
                best = max(sum(agree[k : k + width]) for k in range(len(w) - width + 1))
                if best >= width - width * substitutions // window:
                    b, t = out.get((doc_id, item_id), (0, 0))
                    out[doc_id, item_id] = max(b, best), max(t, sum(agree))
    return out


def test_all_overlaps_equal_those_at_all_shifts(spark):
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(n, " ".join(rnd.choices(vocabulary, k=n))) for n in [30, 16, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1]] + [(50, None), (51, ""), (52, "same " * 13)]
    docs = []
    for i in range(160):
        body = rnd.choices(vocabulary, k=rnd.randrange(0, 40))
        source = cut(items[i % 15][1])
        for at in rnd.sample(range(len(source)), min(len(source), i // 15 % 5)):
            source[at] = "x"
        at = rnd.randrange(len(body) + 1)
        body[at:at] = source
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "same " * 40), (203, items[2][1]), (203, items[2][1]), (None, items[0][1]), (None, items[3][1])]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = plain(docs, items)
    for bound in (1_000_000, 0):
        got = find_all_overlaps(d, t, broadcast_rows=bound).collect()
        assert len(got) == len(expected) and {(r.doc_id, r.item_id): (r.best_window, r.n_words) for r in got} == expected
    assert len(expected) > len({r[:2] for r in brute(docs, items)}) + 20
    assert find_all_overlaps(d.limit(0), t).collect() == [] and find_all_overlaps(d, t.limit(0)).collect() == []


def test_masks_meet_no_exchanged_word_wherever_they_are():
    from itertools import combinations

    from factloom.llm.decontaminate import lossless_masks

    for window, substitutions in ((13, 3), (13, 2), (8, 3), (20, 2)):
        for width in range(1, window + 1):
            s = width * substitutions // window
            masks = lossless_masks(width, s)
            assert len(masks) <= 4 and all(m[0] == m[-1] == "1" and len(m) <= width for m in masks)
            for harm in combinations(range(width), s):
                assert any(all(m[k] == "0" or o + k not in harm for k in range(len(m))) for m in masks for o in range(width - len(m) + 1))
    assert min(m.count("1") for m in lossless_masks(13, 3)) >= 5 and any("0" in m for m in lossless_masks(13, 3))
