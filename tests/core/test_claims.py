"""Merges of claim states against plain Python over random states."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import claims
from factloom.operators.claims import Rule, State

VALUES, EVIDENCE, LINKS = "claim_id long, field string, value string", "claim_id long, evidence_id string, type string, source string, observation string", "claim_id long, field string, evidence_id string"


def identity(kind, source, observation, model=None):
    text = lambda x: "None" if x is None else x
    return kind.replace("_", "-") + "-" + hashlib.sha256(json.dumps([kind, text(source), text(observation), model], ensure_ascii=False).encode()).hexdigest()[:10]


class Plain:
    """A state as dictionaries: values[claim][field], evidence[claim][id] = (type, source, observation), links = set."""

    def __init__(self):
        self.values, self.evidence, self.links = {}, {}, set()

    def frames(self, spark):
        return State(
            spark.createDataFrame([(c, f, v) for c, own in self.values.items() for f, v in own.items()], VALUES),
            spark.createDataFrame([(c, i, *x) for c, own in self.evidence.items() for i, x in own.items()], EVIDENCE),
            spark.createDataFrame(sorted(self.links), LINKS),
        )

    def add(self, claim, kind, source, observation, fields=(), model=None):
        i = identity(kind, source, observation, model)
        self.evidence.setdefault(claim, {}).setdefault(i, (kind, "None" if source is None else source, observation))
        self.links |= {(claim, f, i) for f in fields}
        return i

    def remove(self, kind):
        for c, own in self.evidence.items():
            gone = {i for i, x in own.items() if x[0] == kind}
            self.evidence[c] = {i: x for i, x in own.items() if i not in gone}
            self.links = {x for x in self.links if x[0] != c or x[2] not in gone}

    def unlink(self, claim, field):
        self.links = {x for x in self.links if x[:2] != (claim, field)}

    def same_as(self, state):
        got = {(r.claim_id, r.field): r.value for r in state.values.collect()}
        want = {(c, f): v for c, own in self.values.items() for f, v in own.items()}
        assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None}
        assert len(got) == state.values.count()
        assert sorted(map(tuple, state.evidence.select("claim_id", "evidence_id", "type", "source", "observation").collect()), key=str) == sorted(((c, i, *x) for c, own in self.evidence.items() for i, x in own.items()), key=str)
        assert {tuple(r) for r in state.links.collect()} == self.links and state.links.count() == len(self.links)


FIELDS = [claims._STATUS, claims._CONTEXT, claims._NAME, claims._KIND, claims._SAME, *claims.READ_ANEW, *claims.TOLD_BY_RECORD, "source.uploader_name", "source.uploader_profile", "motivation.claimed_framing", claims._SPOT]
TYPES = ["claim_text", "asr_transcript", "provenance_image_candidate", "platform_metadata", "location_text_candidate", "uploader_url_pattern"]


def random_state(rnd, n=40):
    p = Plain()
    for c in range(n):
        p.values[c] = {f: rnd.choice([None, "", "old " + f, "2022-05-0" + str(rnd.randrange(1, 9))]) for f in FIELDS if rnd.random() < 0.7}
        if rnd.random() < 0.4:
            p.values[c][claims._STATUS] = rnd.choice([claims.EARLIER, "repost"])
        for _ in range(rnd.randrange(4)):
            p.add(c, rnd.choice(TYPES), rnd.choice(["a", "b"]), rnd.choice(["x", "y"]), rnd.sample(FIELDS, 2) + rnd.sample([claims._NAME, claims._CLAIMED], 1))
    return p


RECORD = "claim_id long, source_file string, claim string, url string, content string, platform string, video_url string, video_date string, video_headline string, video_description string, video_transcript string, references array<struct<text:string,refs:array<string>>>"
LINKS_TO = [None, "https://www.youtube.com/@someone/video", "https://x.com/Person/status/1", "https://facebook.com/watch?v=1", "https://example.com/v"]


def random_records(rnd, n=40):
    out = []
    for c in range(n):
        refs = [(rnd.choice(["t", "tt" * 1500, None]), rnd.choice([["r1", "r2"], [], None])) for _ in range(rnd.randrange(3))]
        out.append((c, f"f/{c}.json", rnd.choice(["claim", None]), rnd.choice(["u", None]), "c" * rnd.choice([0, 5, 2500]), rnd.choice(["CNN", "twitter", None, "bbc"]), rnd.choice(LINKS_TO), rnd.choice(["20220503", None, "bad", "2021-01-02"]), rnd.choice(["head", None]), rnd.choice(["desc", ""]), rnd.choice([None, " ", "said " * 500]), refs))
    return out


OFFICIAL = {"cnn": "CNN", "bbc": "BBC News"}
DAY = {"20220503": "2022-05-03", "2021-01-02": "2021-01-02"}


def cut(text, n=2000):
    text = (text or "").strip()
    return text[:n] + "..." if len(text) > n else text


@pytest.mark.parametrize("force", [False, True])
def test_bootstrap(spark, force):
    rnd = random.Random(force)
    p, records = random_state(rnd), random_records(rnd)
    state = claims.bootstrap(p.frames(spark), spark.createDataFrame(records, RECORD), force)
    p.remove("asr_transcript")
    for c, file, claim, url, content, site, video, date, head, desc, said, refs in records:
        own = p.values[c]
        p.add(c, "claim_text", file, claim, ["motivation.claimed_framing"])
        meta = p.add(c, "dataset_video_metadata", file, claims.RECORD_METADATA, claims.TOLD_BY_RECORD)
        p.add(c, "fact_check_article", url, cut(content))
        for text, more in refs:
            p.add(c, "fact_check_evidence", more[0] if more else url, cut(text))
        if (said or "").strip():
            p.add(c, "dataset_transcript", file, cut(said))
        for f, v in (("motivation.claimed_framing", claim), ("date.video_upload_date", DAY.get(date)), ("motivation.original_caption", head), ("motivation.original_description", desc)):
            if force or own.get(f) is None:
                own[f] = v
        if force or own.get("provenance.earliest_known_url") is None:
            own |= {"provenance.earliest_known_url": video, "provenance.earliest_known_date": DAY.get(date), claims._STATUS: "unknown"}
            p.links.add((c, claims._STATUS, meta))
        if name := OFFICIAL.get((site or "").lower()):
            named = {"source.uploader_name": name, claims._NAME: name, claims._KIND: "news outlet", claims._SAME: "true"}
            own |= named
            p.links |= {(c, f, meta) for f in named}
    p.same_as(state)


def test_reset_of_texts(spark):
    rnd = random.Random(5)
    p = random_state(rnd, 60)
    sites, seen = {c: rnd.choice(["cnn", "x", None]) for c in p.values}, {c: '["Rome"]' for c in p.values if rnd.random() < 0.5}
    state = claims.reset_texts(p.frames(spark), spark.createDataFrame([*sites.items()], "claim_id long, platform string"), spark.createDataFrame([*seen.items()], "claim_id long, value string"))
    for c, own in p.values.items():
        vouched = any((c, claims._NAME, i) in p.links for i, x in p.evidence.get(c, {}).items() if x[0] in claims.VOUCHING)
        for f in claims.READ_ANEW:
            own[f] = None
            p.unlink(c, f)
        if own.get(claims._STATUS) != claims.EARLIER:
            own |= {claims._CONTEXT: None, claims._STATUS: "unknown"}
            p.unlink(c, claims._CONTEXT)
        if name := OFFICIAL.get(sites[c] or ""):
            own |= {claims._NAME: name, claims._KIND: "news outlet", claims._SAME: "true"}
        else:
            if not vouched:
                own[claims._NAME] = None
                p.unlink(c, claims._NAME)
            own |= {claims._KIND: None, claims._SAME: None}
            p.unlink(c, claims._KIND)
            p.unlink(c, claims._SAME)
        own["location.candidate_locations"] = seen.get(c, "[]")
    p.same_as(state)


ACCOUNTS = {LINKS_TO[1]: ("someone", "https://www.youtube.com/@someone"), LINKS_TO[2]: ("@Person", "https://x.com/Person")}


def test_web_metadata(spark):
    rnd = random.Random(6)
    p, records = random_state(rnd, 60), random_records(rnd, 60)
    columns = ["page_url", *claims.METADATA_FIELDS, "archive_date", "archive_url", "archive_snapshot"]
    found = []
    for c in range(60):
        row = {k: rnd.choice([None, "", "new " + k]) for k in claims.METADATA_FIELDS} | {"page_url": rnd.choice(["https://p.example", None]), "archive_date": rnd.choice([None, "2020-01-01", "2022-05-05"]), "archive_url": "au", "archive_snapshot": "as"}
        found.append((c, *(row[k] for k in columns)))
    state = claims.web_metadata(p.frames(spark), spark.createDataFrame(records, RECORD), spark.createDataFrame(found, "claim_id long, " + ", ".join(f"{k} string" for k in columns)))
    p.remove("platform_metadata")
    p.remove("uploader_url_pattern")
    for (c, file, _, _, _, site, video, date, head, desc, _, _), row in zip(records, found, strict=True):
        own, new = p.values[c], dict(zip(columns, row[1:], strict=True))
        own |= {"source.uploader_name": OFFICIAL.get((site or "").lower()), "source.uploader_profile": None, "date.video_upload_date": DAY.get(date), "motivation.original_caption": head, "motivation.original_description": desc}
        told = {f: new[k] for k, f in claims.METADATA_FIELDS.items() if new[k]}
        own |= told
        p.add(c, "platform_metadata", new["page_url"] or file, claims.METADATA_FOUND, told)
        link = video or new["page_url"] or file
        name, page = ACCOUNTS.get(link, (None, None))
        guessed = {f: v for f, v in (("source.uploader_name", name), ("source.uploader_profile", page)) if v and not own[f]}
        own |= guessed
        if guessed:
            p.add(c, "uploader_url_pattern", link, claims.NAME_INFERRED, guessed)
        if day := new["archive_date"]:
            known = own.get("provenance.earliest_known_date")
            if not known or day < known:
                own |= {"provenance.earliest_known_date": day, "provenance.earliest_known_url": "au"}
            own["date.earliest_online_date"] = day
            p.add(c, "archive_record", "as", claims.SNAPSHOT, ["provenance.earliest_known_url", "provenance.earliest_known_date", "date.earliest_online_date"])
    for own in p.values.values():  # an empty uploader is none
        for f in ("source.uploader_name", "source.uploader_profile"):
            own[f] = own.get(f) or None
    p.same_as(state)


PLACES = ["Rome", "ROME", "Paris", "Old Goa", "wearing Red", "Lima", " Lima. "]


def plausible(name):
    return bool(name) and name.strip(" .") in ("Rome", "ROME", "Paris", "Old Goa", "Lima")


def bare(name):
    return (name or "").strip(" .").casefold()


def test_merge_of_places(spark):
    rnd = random.Random(7)
    p, candidates, former, reviews = random_state(rnd, 150), [], [], {}
    for c, own in p.values.items():
        own |= {claims._CLAIMED: rnd.choice([None, *PLACES]), claims._VERIFIED: rnd.choice([None, *PLACES]), claims._DIFFERS: rnd.choice([None, "different city"]), claims._SPOT: rnd.choice([None, "{1,2}"]), claims._LISTED: json.dumps(rnd.sample(PLACES, rnd.randrange(5)))}
        for i in list(p.evidence.get(c, {})):
            if rnd.random() < 0.5:
                p.links |= {(c, rnd.choice([claims._CLAIMED, claims._VERIFIED]), i)}
        reviews[c] = rnd.choice([None, "not_started", "automated", "done"])
        former += [(c, x) for x in rnd.sample(PLACES, rnd.randrange(2))]
        for k, name in enumerate(rnd.sample(["Rome", "Paris", "Old Goa", "Quito"], rnd.randrange(4))):
            groups = rnd.sample(["claim", "current_video", "fact_check", "vision"], rnd.randrange(1, 4))
            candidates.append((c, k, name, groups, rnd.choice([None, groups[:1]]), rnd.choice([None, groups]), rnd.choice(["s", None])))
    df = spark.createDataFrame(candidates, "claim_id long, seq int, name string, sources array<string>, event_sources array<string>, event_groups array<string>, source string")
    state = claims.merge_places(p.frames(spark), df, spark.createDataFrame(former, "claim_id long, name string"), spark.createDataFrame([*reviews.items()], "claim_id long, status string"), "ner")
    mine = {(c, i) for c, own in p.evidence.items() for i, x in own.items() if x[0] == "location_text_candidate"}
    foreign = {(c, f) for c, f, i in p.links if (c, i) not in mine}
    p.remove("location_text_candidate")
    for c, own in p.values.items():
        was = {f: own[f] for f in (claims._CLAIMED, claims._VERIFIED)}
        found, ids = [x for x in candidates if x[0] == c], {}
        for _, _, name, sources, _, _, source in found:
            ids[bare(name)] = p.add(c, "location_text_candidate", source or "", "Supported by: " + ", ".join(sources), [claims._LISTED], "ner")
        said = [x[2] for x in found if "claim" in (x[4] or x[3])]
        counts = {x[2]: len({*(x[5] or x[3])} - {"claim"}) for x in found}
        best = [n for n, k in counts.items() if k >= 2 and k == max(counts.values())]
        chosen = {claims._CLAIMED: said[0] if len(said) == 1 else None, claims._VERIFIED: best[0] if len(best) == 1 else None}
        for f in chosen:
            if plausible(was[f]) and ((c, f) in foreign or reviews[c] == "done"):
                continue
            own[f] = chosen[f]
            if chosen[f]:
                p.links.add((c, f, ids[bare(chosen[f])]))
        moved = any(bare(was[f]) != bare(own[f]) for f in was)
        if moved:
            own[claims._DIFFERS] = own[claims._SPOT] = None
        if own[claims._CLAIMED] and own[claims._VERIFIED] and bare(own[claims._CLAIMED]) == bare(own[claims._VERIFIED]):
            own[claims._DIFFERS] = "same"
            if moved:
                p.links |= {(c, claims._DIFFERS, i) for f, n in chosen.items() if n and own[f] == n and not (plausible(was[f]) and ((c, f) in foreign or reviews[c] == "done")) for i in [ids[bare(n)]]}
        listed, old = [x[2] for x in found], {bare(n) for k, n in former if k == c}
        for n in [x.strip(" .") for x in json.loads(own[claims._LISTED]) if plausible(x) and bare(x) not in old] + [own[f] for f in (claims._CLAIMED, claims._VERIFIED) if own[f]]:
            if n.casefold() not in {x.casefold() for x in listed}:
                listed.append(n)
        own[claims._LISTED] = json.dumps(listed, separators=(",", ":"))
    p.same_as(state)


def test_merge_decisions_leaders_and_protection(spark):
    rnd = random.Random(8)
    rules = {"a": Rule("fill"), "b": Rule("update"), "c": Rule("force"), "d": Rule("fill", "a"), "e": Rule("update", "b")}
    old = {(k, f): rnd.choice([None, "1", "2"]) for k in range(200) for f in "abcdefg" if rnd.random() < 0.8}
    new = {(k, f): rnd.choice([None, "1", "3"]) for k in range(200) for f in "abcdef" if rnd.random() < 0.8}
    held = {key for key in old if rnd.random() < 0.2}
    frame = lambda rows: spark.createDataFrame([(*k, v) for k, v in rows.items()], VALUES)
    got = claims.merge(frame(old), frame(new), rules, spark.createDataFrame(sorted(held), "claim_id long, field string"))
    want = {}
    for k, f in {*old, *new}:
        head = rules[f].leader or f if f in rules else f
        o, n, mode = old.get((k, head)), new.get((k, head)), rules[f].mode if f in rules else None
        wants = (k, f) in new and (mode == "force" or (mode == "fill" and o is None) or (mode == "update" and n is not None))
        was, will = old.get((k, f)), new.get((k, f))
        takes = wants and (k, f) not in held
        decision = "protected" if wants and not takes else "kept" if not takes else "same" if was == will else "filled" if was is None else "cleared" if will is None else "replaced"
        want[k, f] = (will if takes else was, was, decision)
    assert {(r.claim_id, r.field): tuple(r)[2:] for r in got.collect()} == want
    derived = {"f": ["a", "c"], "g": ["b"]}
    after = {(r.claim_id, r.field): (r.value, r.decision) for r in claims.invalidated(got, derived).collect()}
    for (k, f), (value, _, decision) in want.items():
        stale = value is not None and any((k, i) in want and (want[k, i][0] or "") != (want[k, i][1] or "") for i in derived.get(f, []))
        assert after[k, f] == ((None, "invalidated") if stale else (value, decision))
    one, two = ({(r.claim_id, r.field): r.fingerprint for r in claims.fingerprints(v, derived).collect()} for v in (frame(old), got.select("claim_id", "field", "value")))
    for k, f in {*one} & {*two}:
        assert (one[k, f] == two[k, f]) == all(old.get((k, i)) == want.get((k, i), (None,))[0] for i in derived[f])


def test_empty_states(spark):
    empty = Plain().frames(spark)
    none = spark.createDataFrame([], RECORD)
    for state in (claims.bootstrap(empty, none), claims.reset_texts(empty, none.select("claim_id", "platform"), none.select("claim_id", F.col("url").alias("value")))):
        assert all(t.count() == 0 for t in state)
