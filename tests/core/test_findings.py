"""Alias closure, seeding, copied fields and verdicts against plain Python over random inputs."""

import json
import random

import pytest

from factloom.operators import findings, judging
from factloom.operators.evidence import DECISIVE

URL = "https://site.example/{}"


def plain_closure(posts, items):
    """The fold in the order of the evidence: aliases by claim, matched (claim, seq)."""
    out, matched = {}, set()
    for c, post in posts:
        known = {post} if post else set()
        for _, seq, urls in sorted((x for x in items if x[0] == c), key=lambda x: x[1]):
            own = {u for u in urls if u}
            if own & known:
                matched.add((c, seq))
                known |= own
        out[c] = known
    return out, matched


def test_alias_closure_follows_the_order_of_the_evidence(spark):
    rnd = random.Random(1)
    posts = [(c, rnd.choice([URL.format(0), None, ""]) if c % 5 == 0 else URL.format(0)) for c in range(60)]
    items = [(c, s, [rnd.choice([URL.format(rnd.randrange(9)), None, ""]) for _ in range(3)]) for c in range(60) for s in range(rnd.randrange(12))]
    chain = [URL.format(k) for k in range(12)]
    posts += [(100, chain[0]), (101, chain[0])]
    items += [(100, k, chain[k : k + 2]) for k in range(11)] + [(101, 10 - k, chain[k : k + 2]) for k in range(11)]  # the second runs against the order
    closed, matched = findings.alias_closure(spark.createDataFrame(posts, "claim_id long, post_url string"), spark.createDataFrame(items, "claim_id long, seq int, urls array<string>"))
    want, hit = plain_closure(posts, items)
    got = {}
    for r in closed.collect():
        got.setdefault(r.claim_id, set()).add(r.url)
    assert got == {c: u for c, u in want.items() if u} and closed.count() == sum(map(len, got.values()))
    assert {tuple(r) for r in matched.collect()} == hit
    assert len(got[100]) == 12 and len(got[101]) == 2
    empty = spark.createDataFrame([], "claim_id long, seq int, urls array<string>")
    assert findings.alias_closure(spark.createDataFrame(posts[:3], "claim_id long, post_url string"), empty)[1].count() == 0


ITEM = "claim_id long, seq int, evidence_id string, type string, verified boolean, requested_url string, source string, final_url string, canonical_url string, observation string, archive_url string, archive_date string"


def test_seeding(spark):
    a, b, c = (URL.format(k) for k in "abc")
    meta = lambda **x: json.dumps(x)
    items = [
        (1, 1, "e1", "platform_metadata", True, a, b, None, None, meta(uploader_name="Jane Roe", upload_date="2022-05-03"), None, None),
        (1, 2, "e2", "platform_metadata", True, None, c, b, None, meta(uploader_name="John Roe", uploader_profile=c), None, None),
        (1, 3, "e3", "platform_metadata", False, a, None, None, None, meta(uploader_name="Nobody"), None, None),
        (1, 4, "e4", "platform_metadata", True, URL.format("x"), None, None, None, meta(uploader_name="Other"), None, None),
        (1, 5, "e5", "platform_metadata", True, a, None, None, None, "no json", None, None),
        (1, 6, "e6", "platform_metadata", True, a, None, None, None, meta(uploader_name="youtube", upload_date="soon"), None, None),
        (1, 7, "a1", "archive_record", True, None, None, None, None, "seen 2021-02-03", c, "2021-02-03"),
        (1, 8, "a2", "archive_record", True, None, None, None, None, "seen 2020-01-01", URL.format("x"), "2020-01-01"),
        (1, 9, "a3", "archive_record", True, None, None, None, None, "seen never", a, "2019-01-01"),
        (1, 10, "a4", "archive_record", True, None, None, None, None, "again 2021-02-03", a, "2021-02-03"),
        (2, 1, "f1", "platform_metadata", True, a, None, None, None, meta(uploader_name="Jane Roe"), None, None),
    ]
    got = findings.seeded(spark.createDataFrame([(1, a + "/?utm_source=x"), (2, None)], "claim_id long, post_url string"), spark.createDataFrame(items, ITEM))
    want = {(1, "source.uploader_name", "John Roe", "e2"), (1, "source.uploader_profile", c, "e2"), (1, "date.video_upload_date", "2022-05-03", "e1"), (1, "date.earliest_online_date", "2021-02-03", "a1")}
    assert {tuple(r) for r in got.collect()} == want


def folded(x):
    return " ".join((x or "").split()).casefold()


def test_copied_fields(spark):
    rnd = random.Random(2)
    types = ["retrieved_page", "retrieved_page", "platform_metadata", "archive_record", "geocoder_result", "keyframe_analysis"]
    texts = ["Filmed in Rome on 2022-05-03 by Jane Roe", "Seen at Paris  by john roe in May 2021", "https://site.example/p says Rome"]
    evidence = [(c, f"e{k}", rnd.choice(types), rnd.random() < 0.7, rnd.choice(["https://site.example/p", "s"]), rnd.choice(texts)) for c in range(600) for k in range(3)]
    fields = {
        "location.verified_location": ["Rome", "paris by", "Lima", " "], "date.estimated_date": ["2022-05-03", "May 2021", "1999"], "date.video_upload_date": ["2022-05-03"], "date.earliest_online_date": ["2022-05-03"],
        "source.original_source_name": ["Jane Roe", "youtube", "nobody"], "source.uploader_profile": ["https://site.example/p?utm_source=q", "https://other.example"], "source.source_mismatch": ["true"], "provenance.provenance_status": ["repost", "Repost", "odd"],
        "provenance.near_duplicate_matches": ['["a","b"]', json.dumps(["x"] * 11)], "provenance.previous_context_summary": ["anything", ""], "location.location_mismatch_type": ["same"],
    }
    kinds = {"source.source_mismatch": ["boolean", "string"], "provenance.near_duplicate_matches": ["list", "string"]}
    answers, citations = [], []
    for c in range(600):
        for path, values in fields.items():
            if rnd.random() < 0.7:
                pillar, field = path.split(".")
                answers.append((c, pillar, field, rnd.choice(values), rnd.choice(kinds.get(path, ["string", "string", "string", "list"]))))
                for _ in range(rnd.randrange(3)):
                    told = rnd.choice(texts)
                    citations.append((c, pillar, field, f"e{rnd.randrange(4)}", rnd.choice([told, told.upper()[6:], told[:7], "not there at all"])))
    present = [(c, "date", "video_upload_date") for c in range(0, 600, 3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got, links = findings.copied_fields(
        frame(answers, "claim_id long, pillar string, field string, value string, kind string"), frame(citations, "claim_id long, pillar string, field string, evidence_id string, quote string"),
        frame(evidence, "claim_id long, evidence_id string, type string, verified boolean, source string, text string"), findings.field_rules(spark, findings.known_enums()), frame(present, "claim_id long, pillar string, field string"))
    by_id = {(e[0], e[1]): e for e in evidence}
    fact = {"retrieved_page"}
    allowed = {"video_upload_date": {"platform_metadata"}, "earliest_online_date": {"archive_record"}, "uploader_profile": {"retrieved_page", "platform_metadata"}, "source_mismatch": {"retrieved_page", "platform_metadata"}}
    want, rests = set(), set()
    for c, pillar, field, value, kind in answers:
        listed = field == "near_duplicate_matches"
        if listed != (kind == "list") or ((c, pillar, field) in present):
            continue
        ok = []
        for k, p, f, i, quote in citations:
            e = by_id.get((c, i))
            if (k, p, f) != (c, pillar, field) or not e or len(quote.strip()) < 8 or folded(quote) not in folded(e[5]):
                continue
            if (e[2] == "geocoder_result") if listed else (e[2] not in allowed.get(field, fact) or not e[3] or e[2] not in DECISIVE):
                continue
            ok.append((quote, e))
        quotes = " ".join(q for q, _ in ok)
        low = folded(quotes)
        if not ok:
            continue
        fits = {
            "verified_location": bool(value.strip()) and folded(value) in low,
            "estimated_date": {"2022-05-03": "2022-05-03" in low, "May 2021": "may 2021" in low}.get(value, False),
            "video_upload_date": "2022-05-03" in low, "earliest_online_date": "2022-05-03" in low,
            "original_source_name": value == "Jane Roe" and "jane roe" in low,
            "uploader_profile": value.startswith("https://site") and ("https://site.example/p" in {e[4] for _, e in ok}),
            "source_mismatch": kind == "boolean", "provenance_status": value == "repost", "near_duplicate_matches": listed and len(json.loads(value)) <= 10,
            "previous_context_summary": bool(value.strip()), "location_mismatch_type": True,
        }[field]
        if fits:
            want.add((c, pillar, field, value))
            rests |= {(c, pillar, field, e[1]) for _, e in ok}
    assert {tuple(r) for r in got.collect()} == want and {tuple(r) for r in links.collect()} == rests
    assert len({w[2] for w in want}) >= 9


# Verdicts

TEXT = {"e1": "The clip was filmed in Rome", "e2": "Nothing of that kind was seen", "e3": "A frame shows the tower"}
KIND = {"e1": "retrieved_page", "e2": "platform_metadata", "e3": "keyframe_analysis"}
FALLBACK = {"both": judging.CONFLICT, "bare": judging.NO_EVIDENCE}


def usable(cited, pillar, seen=None):
    out = []
    for i, quote in cited:
        may = KIND.get(i) == "retrieved_page" or (pillar == "source" and KIND.get(i) == "platform_metadata") or (pillar in ("core", "location") and KIND.get(i) == "keyframe_analysis")
        if may and len(quote.strip()) >= 8 and folded(quote) in folded(TEXT[i]) and (seen is None or i in seen) and (i, quote.strip()) not in out:
            out.append((i, quote.strip()))
    return out


def plain_judge(components, claim, decisions, assessments, citations, reviews, review_citations, seen):
    """One claim: ("error", problems) or ("ok", components, verdict, explanation, cited)."""
    ids, given = [c for c, _ in components], [d[0] for d in decisions]
    problems = {(i, None, "doubled") for i in ids if given.count(i) > 1} | {(i, None, "missing") for i in ids if i not in given} | {(i, None, "unknown") for i in given if i not in ids}
    if problems:
        return "error", problems
    for c in ids:
        needed = {p for (k, p), (s, _) in assessments.items() if k == c and s != "not_applicable"}
        have = {p for (k, p) in reviews if k == c}
        problems |= {(c, p, "unreviewed") for p in needed - have} | {(c, p, "uncalled-for") for p in have - needed}
    if problems:
        return "error", problems
    results, cited = {}, set()
    for c, verdict, said, required in decisions:
        rows, corrected = {}, False
        for p in judging.PILLARS:
            if (c, p) not in assessments:
                continue
            status, told = assessments[c, p]
            side = {s: citations.get((c, p, s), []) for s in ("supports", "refutes")}
            if status != "not_applicable":
                r_status, r_said, error = reviews[c, p]
                if error or (status in judging.KNOWN and r_status not in (status, "unknown")):
                    corrected = True
                else:
                    side = {s: usable(review_citations.get((c, p, s), []), p, seen) for s in side}
                    status, told = r_status, r_said
                    if side["supports"] and side["refutes"]:
                        status, told = "unknown", FALLBACK["both"]
                    elif (status == "supported" and not side["supports"]) or (status == "refuted" and not side["refutes"]):
                        status, told = "unknown", FALLBACK["bare"]
                    corrected |= status != r_status
            rows[p] = (status, told, side)
        counted = {p: r for p, r in rows.items() if p != "provenance" or required}
        states = [r[0] for r in counted.values()]
        fine = {"NEI": True, "FALSE": "refuted" in states, "TRUE": counted.get("core", ("",))[0] == "supported" and not {"unknown", "refuted"} & {*states}}
        label = verdict if fine[verdict] else "NEI"
        changed = corrected or label != verdict
        if changed:
            reasons = list(dict.fromkeys(r[1] for r in counted.values() if r[0] in ("unknown", "refuted")))
            said = " ".join(reasons[:2]) or (judging.NO_RATING if label == "NEI" else counted["core"][1])
        for p, (status, _, side) in counted.items():
            if status in judging.KNOWN:
                s = "supports" if status == "supported" else "refutes"
                held = usable(side[s], p)
                if not held:
                    problems.add((c, p, "without valid evidence"))
                cited |= {(c, p, i, q) for i, q in held}
        results[c] = (label, said, changed, states, counted.get("core", ("",))[0])
    if problems:
        return "error", problems
    states = [s for r in results.values() for s in r[3]]
    verdict, said = claim
    true = all(r[4] == "supported" for r in results.values()) and not {"unknown", "refuted"} & {*states} and all(r[0] != "NEI" for r in results.values())
    final = verdict if {"NEI": True, "FALSE": "refuted" in states, "TRUE": true}[verdict] else "NEI"
    if any(r[2] for r in results.values()) or final != verdict:
        said = " ".join(results[c][1] for c, _ in components if results[c][0] == final) or judging.NO_OVERALL
    return "ok", {c: r[:2] for c, r in results.items()}, final, said, cited


@pytest.mark.parametrize("seed", range(2))
def test_judge(spark, seed):
    rnd = random.Random(seed)
    cases, tables = {}, {k: [] for k in ("components", "claims", "decisions", "assessments", "citations", "reviews", "review_citations", "evidence", "shown")}
    quotes = [("e1", "filmed in Rome"), ("e1", " FILMED  in rome "), ("e2", "Nothing of that"), ("e3", "shows the tower"), ("e1", "elsewhere quoted"), ("e1", "short")]
    for n in range(250):
        calm = rnd.random() < 0.2  # everything is supported and confirmed
        components = [(f"c{k}", k) for k in range(rnd.randrange(1, 4))]
        decided = [c for c, _ in components]
        if not calm and rnd.random() < 0.15:
            decided = rnd.choice([decided[1:], [*decided, "c9"], [*decided, decided[0]]])
        decisions = [(c, "TRUE" if calm else rnd.choice(["TRUE", "FALSE", "NEI"]), f"said of {c}", rnd.random() < 0.5) for c in decided]
        assessments, citations, reviews, review_citations = {}, {}, {}, {}
        for c, _ in components:
            for p in ["core", *rnd.sample(judging.PILLARS[1:], 2)]:
                status = rnd.choice(["supported", "supported", "refuted", "unknown", "not_applicable"]) if p != "core" else rnd.choice(["supported", "supported", "refuted", "unknown"])
                status = "supported" if calm else status
                assessments[c, p] = (status, f"{p} was {status}")
                own = "supports" if status == "supported" else "refutes"
                citations[c, p, own] = [("e1", "filmed in Rome")] if rnd.random() < 0.95 else rnd.sample(quotes, 1)
                if calm:
                    reviews[c, p], review_citations[c, p, "supports"] = ("supported", "confirmed", None), [("e1", "filmed in Rome")]
                elif status != "not_applicable" and rnd.random() < 0.99:
                    # Mostly a confirmed or downgraded finding; sometimes a reversal or a broken contract.
                    r_status = rnd.choice([status, status, status, "unknown", "supported", "refuted"])
                    reviews[c, p] = (r_status, f"{p} reviewed", "bad contract" if rnd.random() < 0.05 else None)
                    review_citations[c, p, "supports" if r_status == "supported" else "refutes"] = rnd.sample(quotes[:2] if rnd.random() < 0.8 else quotes, 2)
                    if rnd.random() < 0.05:
                        review_citations[c, p, rnd.choice(["supports", "refutes"])] = rnd.sample(quotes, 1)
        seen = {e for e in TEXT if calm or rnd.random() < 0.95}
        claim = ("TRUE" if calm else rnd.choice(["TRUE", "FALSE", "NEI"]), "said overall")
        cases[n] = plain_judge(components, claim, decisions, assessments, citations, reviews, review_citations, seen)
        tables["components"] += [(n, c, k, f"text of {c}") for c, k in components]
        tables["claims"].append((n, *claim))
        tables["decisions"] += [(n, *d) for d in decisions]
        tables["assessments"] += [(n, *k, *v) for k, v in assessments.items()]
        tables["reviews"] += [(n, *k, *v) for k, v in reviews.items()]
        tables["citations"] += [(n, *k, *x) for k, v in citations.items() for x in v]
        tables["review_citations"] += [(n, *k, *x) for k, v in review_citations.items() for x in v]
        tables["evidence"] += [(n, i, KIND[i], i != "e3", t) for i, t in TEXT.items()]
        tables["shown"] += [(n, i, TEXT[i]) for i in seen]
    cite = "claim_id long, component_id string, pillar string, side string, evidence_id string, quote string"
    schemas = {
        "components": "claim_id long, component_id string, place int, text string", "claims": "claim_id long, verdict string, explanation string", "decisions": "claim_id long, component_id string, verdict string, explanation string, provenance_required boolean",
        "assessments": "claim_id long, component_id string, pillar string, status string, explanation string", "citations": cite, "reviews": "claim_id long, component_id string, pillar string, status string, explanation string, error string", "review_citations": cite,
        "evidence": "claim_id long, evidence_id string, type string, verified boolean, text string", "shown": "claim_id long, evidence_id string, text string",
    }
    frames = {k: spark.createDataFrame(v, schemas[k]) for k, v in tables.items()}
    got = judging.judge(**frames)
    errors = {}
    for r in got.errors.collect():
        errors.setdefault(r.claim_id, set()).add(tuple(r)[1:])
    assert errors == {n: x[1] for n, x in cases.items() if x[0] == "error"}
    fine = {n: x for n, x in cases.items() if x[0] == "ok"}
    assert {(r.claim_id, r.component_id): (r.verdict, r.explanation) for r in got.components.collect()} == {(n, c): v for n, x in fine.items() for c, v in x[1].items()}
    assert {r.claim_id: (r.verdict, r.explanation) for r in got.claims.collect()} == {n: x[2:4] for n, x in fine.items()}
    assert {(r.claim_id, r.component_id, r.pillar, r.evidence_id, r.quote) for r in got.citations.collect()} == {(n, *y) for n, x in fine.items() for y in x[4]}
    assert {x[2] for x in fine.values()} == {"TRUE", "FALSE", "NEI"} and len(errors) > 20 and got.review_errors.count() > 10


def test_questions(spark):
    claims = spark.createDataFrame([(1, "NEI"), (2, "NEI"), (3, "TRUE"), (4, "NEI"), (5, "NEI")], "claim_id long, verdict string")
    components = spark.createDataFrame([(n, f"c{k}", k, f"t{k}") for n in range(1, 6) for k in range(2)], "claim_id long, component_id string, place int, text string")
    verdicts = spark.createDataFrame([(n, f"c{k}", "NEI" if k and n != 4 else "TRUE") for n in range(1, 6) for k in range(2)], "claim_id long, component_id string, verdict string")
    asked = spark.createDataFrame([(2, 0, "Who filmed it?")], "claim_id long, place int, question string")
    failed = spark.createDataFrame([(1, "source", 1), (1, "date", 0), (1, "date", 2)], "claim_id long, pillar string, place int")
    seen = spark.createDataFrame([(1,), (4,)], "claim_id long")
    got = [tuple(r) for r in judging.questions(claims, components, verdicts, asked, failed, seen).orderBy("claim_id", "place").collect()]
    ask = "What evidence would verify this claim: {}?"
    assert got == [
        (1, -1, "What independent evidence can resolve the unknown findings after the date, source agent analyses failed?"), (1, 1, ask.format("t1")), (2, 0, "Who filmed it?"),
        (4, -1, "Which independent evidence corroborates the claim beyond the available video information?"), (4, 0, ask.format("t0")), (4, 1, ask.format("t1")), (5, 1, ask.format("t1")),
    ]
