"""Topics brought together against a plain fold, and runs of a model against a plain recursion."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import runs
from colloquy.operators.consolidation import consolidated
from colloquy.operators.topics import detection_answer
from colloquy.sources.store import KeyedStore


def plain_fold(rows, stems, most):
    """The rules of consolidation told over a plain list, each new topic against all before; rows in order: (chunk, label, description, ids); stems: words -> set."""
    numbers = lambda s: re.findall(r"\d+", s)
    opposed = lambda a, b: any((a & set(x) and b & set(y)) or (a & set(y) and b & set(x)) for x, y in T.OPPOSED_STEMS)
    done = []

    def find(items, label, description, ids, key):
        for t in items:
            if key is not None and t["key"] == key:
                return t
        own, all_ = stems(label), stems(f"{label} {description}")
        for t in items if all_ else []:
            if numbers(label) != t["numbers"] or not t["all"] or opposed(own, t["own"]):
                continue
            both = own & t["own"]
            if set(ids) & set(t["ids"]) and (both or len(all_ & t["all"]) >= 2) or len(both) >= 2 and len(both) / len(own | t["own"]) >= 0.5:
                return t
        return None

    def cite(t, ids):
        t["ids"] += [i for i in dict.fromkeys(ids) if i not in t["ids"]]

    for chunk, label, description, ids, key in rows:
        t = find(done, label, description, ids, key)
        own, all_ = stems(label), stems(f"{label} {description}")
        if t is None:
            done.append({"key": key, "label": label, "text": description, "ids": list(ids), "chunks": {chunk}, "numbers": numbers(label), "own": set(own), "all": set(all_), "n": len(done)})
            continue
        t["chunks"].add(chunk)
        cite(t, ids)
        t["all"] |= all_
        if len(t["text"]) < len(description) <= 300:
            t["text"] = description
        if len(own) > len(t["own"]) and len(label) <= 55 or len(own) == len(t["own"]) and len(t["label"]) < len(label) <= 45:
            t["label"], t["own"] = label, set(own)
        else:
            t["own"] |= own
    again = True
    while again:
        again = False
        for k in range(len(done) - 1, 0, -1):
            t = done[k]
            home = find(done[:k], t["label"], t["text"], t["ids"], None)
            if home:
                home["chunks"] |= t["chunks"]
                cite(home, t["ids"])
                home["all"] |= t["all"]
                home["own"] |= t["own"]
                if len(home["text"]) < len(t["text"]) <= 300:
                    home["text"] = t["text"]
                del done[k]
                again = True
                break
    if len(done) <= most:
        return done
    return sorted(done, key=lambda t: (-len(t["chunks"]), -len(t["ids"]), t["n"], t["key"]))[:most]


def test_consolidation_against_a_plain_fold(spark):
    rng = random.Random(12)
    words = ["viaggio", "milano", "treno", "biglietti", "acquisto", "restituzione", "laptop", "portatile", "docker", "deploy", "casa", "mutuo", "banca", "2024", "2025", "di", "per", "riunione", "ufficio"]
    rows = []
    for d in range(25):
        for c in range(4):
            for k in range(rng.randint(0, 5)):
                label = rng.choice(["", "Topic: ", "'"]) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
                rows.append((f"d{d}", c, k, label, rng.choice(["", "description: "]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), [f"e{rng.randrange(9)}" for _ in range(rng.randint(1, 3))]))
    rows = [(*r[:5], list(dict.fromkeys(r[5]))) for r in rows]
    df = spark.createDataFrame(rows, "document_id string, chunk int, topic_no int, label string, description string, evidence_ids array<string>").repartition(5)
    c = F.col
    told = df.select("*", T.bare_label(c("label")).alias("l"), T.bare_description(c("description")).alias("t")).withColumn("key", F.coalesce(F.nullif(T.canonical_label(c("l")), F.lit("")), F.nullif(T.normalized_label(c("l")), F.lit("")), F.lower("l"))).collect()
    known = {w: set(s) for w, s in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.domain_stems(c("w"))).collect()}
    stems = lambda text: set().union(*(known.get(w, set()) for w in text.lower().replace("'", " ").split()))
    got = {}
    for r in consolidated(df, 3).orderBy("document_id", "place").collect():
        got.setdefault(r.document_id, []).append((r.label, r.description, r.evidence_ids, r.support))
    merged = 0
    for d in {r[0] for r in rows}:
        own = sorted((r for r in told if r.document_id == d), key=lambda r: (r.chunk, r.topic_no))
        want = plain_fold([(r.chunk, r.l, r.t, r.evidence_ids, r.key) for r in own], stems, 3)
        merged += any(len(t["ids"]) > 3 for t in want)
        assert got[d] == [(t["label"], t["text"], t["ids"], len(t["chunks"])) for t in want]
    assert merged > 5


def test_consolidation_edges(spark):
    rows = [
        ("d", "c1", 0, "Traffico di armi", "x", ["e1"]), ("d", "c2", 1, "Traffico d'armi", "longer", ["e2"]), ("d", "c1", 2, "Viaggio ferroviario Milano", "", ["e3"]),
        ("d", "c3", 3, "Treni per Milano", "", ["e3", "e4"]), ("d", "c3", 4, "Restituzione biglietti Milano", "", ["e9"]), ("d", "c3", 5, "Acquisto biglietti Milano", "", ["e9"]), ("o", "c1", 6, "Treni per Milano", None, None),
        (None, "c1", 7, None, None, ["e"]),
    ]
    df = spark.createDataFrame(rows, "document_id string, chunk string, topic_no int, label string, description string, evidence_ids array<string>")
    got = {(r.document_id, r.label): (r.support, r.evidence_ids, r.description) for r in consolidated(df).collect()}
    assert got["d", "Traffico di armi"] == (2, ["e1", "e2"], "longer") and got["d", "Viaggio ferroviario Milano"] == (2, ["e3", "e4"], "") and ("d", "Restituzione biglietti Milano") in got and got["o", "Treni per Milano"] == (1, [], "")
    assert got[None, ""] == (1, ["e"], "") and consolidated(df.limit(0)).count() == 0


SECTIONS = [(f"d{d}", c, n, f"d{d}-{c}-{n}", "needle" if (d + c + n) % 7 == 0 else "poison" if (d * c + n) % 11 == 5 else "flood" if (d, c, n) == (1, 1, 1) else f"hay {n}") for d in range(3) for c in range(3) for n in range(9)]
SECTION_SCHEMA = "document_id string, chunk int, n int, evidence_id string, text string"


def fake_model():
    # made by a function, so that it goes to executors whole
    def fake(prompts):
        """Finds the sections whose text is the topic; breaks where a poisonous one isn't alone, never answers where there is a flood."""
        out = []
        for p in prompts:
            _, topic, _, *lines = p.split("\n")
            rows = [json.loads(x) for x in lines]
            if any(r["text"] == "flood" for r in rows):
                out.append(runs.Reply(None, None, 400, '{"error": "context too long"}'))
            elif any(r["text"] == "poison" for r in rows) and len(rows) > 1:
                out.append(runs.Reply('{"decision": ' if len(rows) % 2 else json.dumps({"decision": "PRESENT", "evidence_ids": ["made up"], "rationale": "r"})))
            else:
                hit = [r["id"] for r in rows if r["text"] == topic]
                out.append(runs.Reply(json.dumps({"decision": "PRESENT" if hit else "ABSENT", "evidence_ids": hit, "rationale": "because"})))
        return out

    return fake


fake = fake_model()


def recursion(rows, topic, node="", attempts=2):
    """(leaves, calls) of a request by plain recursion: leaves (node, low, decision or None), calls (node, attempt)."""
    prompt = "\n".join(["TOPIC", topic, "", *(json.dumps({"id": r[3], "text": r[4]}) for r in rows)])
    calls = []
    for attempt in range(1, attempts + 1):
        calls.append((node, attempt))
        reply = fake([prompt])[0]
        if reply.text is None:
            break
        try:
            answer = json.loads(reply.text)
            if set(answer["evidence_ids"]) <= {r[3] for r in rows}:
                return [(node, rows[0][2], answer["decision"], answer["evidence_ids"])], calls
        except ValueError:
            pass
    if len(rows) > 1 and len(node) < 3:
        mid = len(rows) // 2
        left, right = recursion(rows[:mid], topic, node + "a"), recursion(rows[mid:], topic, node + "b")
        return left[0] + right[0], calls + left[1] + right[1]
    return [(node, rows[0][2], None, [])], calls


def test_detection_against_a_recursion(spark, tmp_path):
    sections = spark.createDataFrame(SECTIONS, SECTION_SCHEMA)
    topics = spark.createDataFrame([("t1", "needle", ""), ("t2", "gold", "")], "topic_id string, label string, description string")
    store = KeyedStore(spark, str(tmp_path / "s"), ["document_id", "topic_id", "chunk"], 4)
    verdicts, evidence, run = runs.detection_run(sections, topics, fake, store=store)
    want, wanted_calls, wanted_evidence, whole = {}, Counter(), set(), set()
    for d in range(3):
        for topic, label in (("t1", "needle"), ("t2", "gold")):
            leaves = []
            for c in range(3):
                own = [r for r in SECTIONS if r[0] == f"d{d}" and r[1] == c]
                found, calls = recursion(own, label)
                leaves += found
                wanted_calls.update((f"d{d}", topic, c, *x) for x in calls)
                if all(x[2] for x in found):
                    whole.add((f"d{d}", topic, c))
            told = [x[2] for x in leaves]
            want[f"d{d}", topic] = (len(leaves), told.count(None), "PRESENT" if "PRESENT" in told else "UNCERTAIN" if None in told else "ABSENT")
            wanted_evidence |= {(f"d{d}", topic, e) for x in leaves if x[2] == "PRESENT" for e in x[3]}
    assert {(r.document_id, r.topic_id): (r.n_parts, r.n_failed, r.decision) for r in verdicts.collect()} == want
    assert {(r.document_id, r.topic_id, r.evidence_id) for r in evidence.collect()} == wanted_evidence
    assert Counter((r.document_id, r.topic_id, r.chunk, r.node, r.attempt) for r in run.attempts.collect()) == wanted_calls and any(v[2] == "UNCERTAIN" for v in want.values())
    kinds = {r.outcome for r in run.failures(["topic_id"]).collect()}
    assert kinds == {"OK", "JSON_SYNTAX", "INVALID_CITATION", "BACKEND_ERROR"}
    m = {r.topic_id: r for r in run.metrics(["topic_id"]).collect()}
    assert m["t1"].n_calls == sum(n for k, n in wanted_calls.items() if k[1] == "t1") and m["t1"].n_repeated == sum(k[1] == "t1" and k[4] > 1 for k in wanted_calls) and m["t1"].depth == 3
    assert {(r.document_id, r.topic_id, r.chunk) for r in store.read().collect()} == whole
    again, same, second = runs.detection_run(sections, topics, fake, store=store)
    assert {(r.document_id, r.topic_id): (r.n_parts, r.n_failed, r.decision) for r in again.collect()} == want and {(r.document_id, r.topic_id, r.evidence_id) for r in same.collect()} == wanted_evidence
    assert not {(r.document_id, r.topic_id, r.chunk) for r in second.attempts.collect()} & whole
    store.delete(topics.select("topic_id"))
    assert store.read() is None or store.read().count() == 0


def test_verification(spark):
    sections = spark.createDataFrame(SECTIONS, SECTION_SCHEMA)
    found = [("d0", "t1", "needle", "", ["d0-0-0", "d0-1-6", "made up"]), ("d0", "t2", "gold", "", ["d0-0-0"]), ("d2", "t3", "needle", "", ["elsewhere"])]
    discovered = spark.createDataFrame(found, "document_id string, topic_id string, label string, description string, evidence_ids array<string>")
    verified, run = runs.verification_run(sections, discovered, fake)
    got = {(r.document_id, r.topic_id): r for r in verified.collect()}
    own = [e for d, _, _, e, text in SECTIONS if d == "d0" and text == "needle"]
    assert got["d0", "t1"].detected_ids == own and got["d0", "t1"].status == "CONSISTENT" and got["d0", "t1"].n_overlap == 2 and got["d0", "t1"].jaccard == round(2 / (len(own) + 1), 4)
    assert got["d0", "t2"].status == "INCONSISTENT_ABSENT" and got["d2", "t3"].status == "PARTIALLY_CONSISTENT" and run.attempts.where("document_id = 'd1'").count() == 0


def test_authenticated(spark):
    stored = spark.createDataFrame([("d", 0, 0, "Treno Milano", "a", ["e1"]), ("d", 1, 0, "Treni per Milano", "bb", ["e2"])], "document_id string, chunk int, topic_no int, label string, description string, evidence_ids array<string>")
    presented = consolidated(stored)
    assert runs.authenticated(presented, stored) and not runs.authenticated(presented.withColumn("label", F.lit("x")), stored) and not runs.authenticated(presented.limit(0), stored)


def test_discovery(spark):
    sections = spark.createDataFrame([("d", c, n, f"e{c}{n}", t) for c, part in enumerate([["Compriamo il biglietto", "ciao"], ["Prendiamo il treno per Milano", "<Media omessi>", "ok"]]) for n, t in enumerate(part)], SECTION_SCHEMA)

    def finds(prompts):
        out = []
        for p in prompts:
            rows = [json.loads(x) for x in p.split("\n")[1:]]
            topics = [{"label": "Treno Milano", "short_description": r["text"], "evidence_ids": [r["id"]]} for r in rows if "treno" in r["text"]]
            topics += [{"label": "Treni per Milano", "short_description": "x", "evidence_ids": [r["id"]]} for r in rows if "biglietto" in r["text"]]
            topics += [{"label": "Saluti", "short_description": "x", "evidence_ids": [r["id"]]} for r in rows if r["text"] == "ciao"]
            out.append(runs.Reply(json.dumps({"topics": topics})))
        return out

    topics, run = runs.discovery_run(sections, finds)
    got = topics.collect()
    assert [(r.label, r.evidence_ids, r.support, r.description) for r in got] == [("Treni per Milano", ["e00", "e10"], 2, "Prendiamo il treno per Milano")]
    assert run.leaves.where("category IS NOT NULL").count() == 0


def test_strict_answers(spark):
    whole = json.dumps({"decision": "ABSENT", "evidence_ids": [], "rationale": "r"})
    cases = {whole: None, whole + " x": "INVALID_JSON", whole + whole: "INVALID_JSON", whole + "]": "INVALID_JSON", whole + "}": "INVALID_JSON", whole + ", 1": "INVALID_JSON", f"```json\n{whole}\n```": None, f" {whole}\n": None, "": "INVALID_JSON"}
    df = spark.createDataFrame([(a,) for a in cases], "a string").select("a", detection_answer(F.col("a"))["error"].alias("e"))
    assert {r.a: r.e for r in df.collect()} == cases
