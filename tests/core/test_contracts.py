"""Contracts, claim records and article blocks against plain Python."""

import json
import random
import re

import pytest

from factloom.functions import pages
from factloom.operators import contracts
from factloom.operators.contracts import Keyed, Many, Maybe, Object, Plain, Text
from factloom.sources import records


def one_of(options):
    quoted = [f"'{x}'" for x in options]
    return "Input should be " + (quoted[0] if len(quoted) == 1 else ", ".join(quoted[:-1]) + " or " + quoted[-1])


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "list" if isinstance(v, list) else "object"


def plain(schema, v, path=()):
    """(path, message) of all that breaks a schema."""
    if isinstance(schema, Maybe):
        return [] if v is None else plain(schema.of, v, path)
    at, k, says = ".".join(path) or "$", kind(v), contracts.SAYS
    if isinstance(schema, Text):
        if schema.options:
            return [] if v in schema.options else [(at, one_of(schema.options))]
        return [(at, says["string"])] if k != "string" else [(at, says["blank"])] if schema.filled and not v.strip(" ") else []
    if isinstance(schema, Plain):
        fits = schema.kind in ("any", k) or (schema.kind, k) in (("number", "integer"), ("text or object", "string"), ("text or object", "object"))
        return [] if fits else [(at, says[schema.kind])]
    if isinstance(schema, Many):
        if k != "list":
            return [(at, says["list"])]
        return ([(at, says["short"])] if schema.filled and not v else []) + [e for i, x in enumerate(v) for e in plain(schema.of, x, (*path, str(i)))]
    if k != "object":
        return [(at, says["object"])]
    if isinstance(schema, Keyed):
        return [e for key, x in v.items() for e in ([(".".join((*path, key, "[key]")), one_of(schema.keys))] if schema.keys and key not in schema.keys else []) + plain(schema.of, x, (*path, key))]
    out = [(".".join((*path, key)), says["missing"]) for key in schema.fields if key not in v and key not in schema.optional]
    out += [(".".join((*path, key)), says["extra"]) for key in v if key not in schema.fields]
    return out + [e for key, x in v.items() if key in schema.fields for e in plain(schema.fields[key], x, (*path, key))]


def valid(rnd, schema):
    if isinstance(schema, Maybe):
        return None if rnd.random() < 0.5 else valid(rnd, schema.of)
    if isinstance(schema, Text):
        return rnd.choice(schema.options or ["text", "é \"quoted\"", "1"])
    if isinstance(schema, Plain):
        return {"boolean": True, "null": None, "integer": 3, "number": 2.5, "text or object": rnd.choice(["s", {"a": [1]}]), "any": [1, {"x": None}]}[schema.kind]
    if isinstance(schema, Many):
        return [valid(rnd, schema.of) for _ in range(rnd.randrange(1, 3))]
    if isinstance(schema, Keyed):
        return {k: valid(rnd, schema.of) for k in rnd.sample(schema.keys or ("any", "key"), 2)}
    return {k: valid(rnd, x) for k, x in schema.fields.items() if k not in schema.optional or rnd.random() < 0.5}


def broken(rnd, v):
    """The value with something changed, somewhere within it."""
    if isinstance(v, dict) and v and rnd.random() < 0.85:
        key = rnd.choice(list(v))
        if rnd.random() < 0.2:
            return {k: x for k, x in v.items() if k != key}
        return {**v, key: broken(rnd, v[key])} if rnd.random() < 0.8 else {**v, "zz": 1}
    if isinstance(v, list) and v and rnd.random() < 0.8:
        return [broken(rnd, x) if i == 0 else x for i, x in enumerate(v)]
    return rnd.choice([None, "", " ", "odd", 7, 1.5, True, [], {}, [1], {"a": 1}])


LOOSE = Object({"n": Plain("number"), "i": Plain("integer"), "free": Keyed(Many(Plain("any"))), "deep": Many(Many(Object({"x": Maybe(Many(Text(), filled=True))}))), "one": Text(options=("only",))}, frozenset({"deep"}))


@pytest.mark.parametrize("name", ["verdict", "provenance", "location", "claim", "loose"])
def test_walk_equals_plain_validation(spark, name):
    schema = {"verdict": contracts.VERDICT, "claim": contracts.CLAIM, "loose": LOOSE}.get(name) or contracts.pillar_answer(name)
    rnd = random.Random(name)
    values = [valid(rnd, schema) for _ in range(40)]
    values += [broken(rnd, v) for v in values * 3] + [broken(rnd, broken(rnd, broken(rnd, v))) for v in values * 2] + [[], "text", 3, None]
    texts = [json.dumps(v, ensure_ascii=False) for v in values] + ["", "{", '{"a": NaN}', None]
    want = [sorted(plain(schema, v)) for v in values] + [[("$", contracts.SAYS["broken"])]] * 4
    got = [[] for _ in texts]
    for r in contracts.errors(spark.createDataFrame(list(enumerate(texts)), "id int, answer string"), schema).collect():
        got[r.id].append((r.path, r.message))
    assert [sorted(x) for x in got] == want
    assert all(not w for w in want[:40]) and sum(map(bool, want)) > 100


def test_reports_give_the_first_errors_and_the_number_of_the_others(spark):
    texts = ['{"i": "x", "free": {"b": 1, "a": [2]}, "one": "two", "zz": 0, "deep": [[{"x": []}], 3]}', '{"n": 1, "i": 2, "free": {}, "one": "only"}']
    got = contracts.reports(spark.createDataFrame(list(enumerate(texts)), "id int, answer string"), LOOSE, "Loose").collect()
    assert [tuple(r) for r in got] == [(0, 7, "Loose: n: Field required; i: Input should be a valid integer; free.b: Input should be a valid list; 4 more validation errors")]


def test_claim_records(spark, tmp_path):
    record = {"claim": "c", "rating": "True", "url": "u", "content": "x", "evidences": {"num_of_evidence": 3, "evidence1": ["t", ["r"]], "evidence2": ["s"], "evidence3": [], "evidence4": ["beyond"]}, "relationship_with_evidence": {}, "video_information": {"video_url": " v ", "platform": "", "video_date": "2020", "video_headline": None, "video_description": "d", "video_transcript": " "}}
    with pytest.raises(FileNotFoundError, match="train_val"):
        records.claims(spark, str(tmp_path))
    for split, ids in (("train_val", "ab"), ("test", "c")):
        (tmp_path / split).mkdir()
        for i in ids:
            (tmp_path / split / f"{i}.json").write_text(json.dumps(record))
    rows = records.claims(spark, str(tmp_path))
    assert sorted((r.claim_id, r.legacy_split) for r in rows.collect()) == [("a", "train_val"), ("b", "train_val"), ("c", "test")] and "broken" not in rows.columns
    assert sorted(tuple(r) for r in records.claim_refs(rows).collect() if r.claim_id == "a") == [("a", 1, "t", ["r"]), ("a", 2, "s", [])]
    assert {tuple(r)[1:] for r in records.evidence_counts(rows).collect()} == {(3, 2, 1)}
    assert tuple(records.label_free(rows).first())[1:] == ("c", "v", None, {"description": "d", "upload_date": "2020"})
    odd = spark.createDataFrame([(1, None), (2, "[1]"), (3, '{"num_of_evidence": -1}'), (4, '{"evidence1": ["x"]}'), (5, '{"num_of_evidence": "2", "evidence1": ["x", "no list"], "evidence02": ["y"]}')], "claim_id int, evidences string")
    assert sorted(map(tuple, records.evidence_counts(odd).collect())) == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 2, 1, 0)]
    (tmp_path / "test" / "d.json").write_text("{broken")
    with pytest.raises(ValueError, match="Broken record: d"):
        records.claims(spark, str(tmp_path))
    (tmp_path / "test" / "d.json").write_text(json.dumps(record))
    (tmp_path / "test" / "a.json").write_text(json.dumps(record))
    with pytest.raises(ValueError, match="Duplicate claim ID: a"):
        records.claims(spark, str(tmp_path))


def test_split_lists_are_sorted(spark, tmp_path):
    rnd = random.Random(3)
    ids = [(f"c{rnd.randrange(10**6)}", rnd.choice(["train", "test"])) for _ in range(300)]
    records.write_splits(spark.createDataFrame(ids, "claim_id string, split string"), str(tmp_path / "s"))
    for split in ("train", "test"):
        lines = [x for f in sorted((tmp_path / "s" / f"split={split}").glob("part-*")) for x in f.read_text().split()]
        assert lines == sorted(i for i, s in ids if s == split)


STORY = "<p>" + "Floods hit northern valleys after heavy rain. " * 12 + "</p>"


def test_articles(spark):
    rows = [
        (f"<main><article><h2>Other story</h2><p>Short card</p></article><article><h1>Floods hit valleys</h1>{STORY}</article></main>", "Floods hit northern valleys", None, "Floods hit valleys Floods"),
        ("<body><article><h2>Unrelated teaser</h2>small</article></body>", "Floods hit northern valleys", None, None),
        ("<article><h2>Unrelated teaser</h2>small</article>", "Live video", "Floods there", None),
        ("<article>small without heading</article>", "Floods", None, "small without heading"),
        ("<body>no <b>parts</b><script>var x = 'Floods'</script> at all</body>", "Floods", None, "no parts at all"),
        ("plain text", None, None, "plain text"),
        ("", "x", None, ""), (None, "x", None, ""),
        ('<div itemprop="x articleBody">Floods inside <article>Floods nested valleys</article></div>', "Floods nested", None, "Floods nested valleys"),
        ("<main>equal Floods</main><article>equal Floods</article>", "Floods", None, "equal Floods"),
        ("<article><h1>Floods<p>unclosed", "Floods", None, "Floods unclosed"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, html string, title string, description string")
    got = {r.i: r.article for r in pages.article(df, "html", "title", "description").collect()}
    for i, (_, _, _, want) in enumerate(rows):
        assert got[i] == want if not (want or "").endswith("valleys Floods") else got[i].startswith(want), i


def test_blocks_equal_a_plain_reading(spark):
    rnd = random.Random(4)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice([" w1 ", "w2", " ", "w3 w4"])
        tag = rnd.choice(["div", "article", "main", "p", "h1", "h2", 'section itemprop="articleBody"'])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randrange(3))) + f"</{tag.split()[0]}>"

    for _ in range(200):
        page = "".join(tree(4) for _ in range(3))
        spots = [(m.start(), m.end(), m[1].split()[0], "itemprop" in m[1]) for m in re.finditer(r"<([a-z][^>]*)>", page)]

        def inner(end, tag, page=page):
            depth, at = 1, end
            for m in re.finditer(rf"<(/?){tag}[ >]", page[end:]):
                depth += -1 if m[1] else 1
                if not depth:
                    at = end + m.start()
                    break
            return page[end:at]

        def text(part):
            return " ".join(x.strip() for x in re.split("<[^>]*>", part) if x.strip())

        found = [(0, inner(e, t)) for _, e, t, _ in spots if t in ("article", "main")] + [(1, inner(e, t)) for _, e, t, p in spots if p]
        want = [(text(x), [text(x[m.end() :][: len(inner(m.end(), m[1], x))]) for m in re.finditer(r"<(h[12])>", x)]) for _, x in found]
        got = [(b["text"], b["heads"]) for b in pages._blocks_of(page)]
        assert got == (want or [(text(page), [text(inner(e, t)) for _, e, t, _ in spots if t in ("h1", "h2")])])
