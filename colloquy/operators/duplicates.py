"""Possible duplicates among records: equal texts at one time from compatible senders."""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from .staging import kept

#: What tells a record's sender and type within a group of equal texts.
PROFILE = ["source", "kind", "raw", "phone", "jid_local", "message_type"]
VAGUE_TYPES = ("UNKNOWN", "OTHER", None)


class _Cluster:
    """What the members of a cluster have told so far. Members are compatible, so there is one type, phone, JID and alias at most."""

    __slots__ = ("type", "local", "phone", "jid", "jid_local", "alias", "vague", "open_type", "sources", "total")

    def __init__(self):
        self.type = self.phone = self.jid = self.jid_local = self.alias = None
        self.local = self.vague = self.open_type = False
        self.sources, self.total = set(), 0

    def add(self, sender: tuple, kind: str | None, of: str | None, n: int) -> None:
        source, raw, phone, jid_local = sender
        self.total += n
        if of is None:
            self.open_type = True
        else:
            self.type = of
        if kind == "local_user":
            self.local = True
        elif kind == "phone":
            self.phone = phone
        elif kind == "jid":
            self.jid, self.jid_local = raw, jid_local or None
        elif kind == "alias":
            self.alias = raw
            self.sources.add(source)
        else:
            self.vague = True

    def places(self) -> list[tuple]:
        """The questions that this cluster answers: which records, by sender, it is open to (whatever its type)."""
        out = [("any",)]
        if not (self.phone or self.jid or self.alias):
            out.append(("local",))
        if not self.local:
            if self.alias is None:
                out.append(("alias",))
            else:
                out.append(("alias", self.alias))
            if self.jid is None:
                out.append(("jid", "of phone", self.phone))
                out.append(("jid", "of any"))
            else:
                out.append(("jid", self.jid))
            if self.phone:
                out.append(("phone", self.phone))
            else:
                out.append(("phone", "of jid", self.jid_local))
        return out

    def matched(self) -> bool:
        """Whether all its records, of which there are several, are told to be of one sender and one type."""
        if self.total == 1:
            return True
        known = self.phone or self.jid
        if self.vague or self.open_type or self.alias and (known or len(self.sources) > 1):
            return False
        return not (self.phone and self.jid and not self.jid_local)


def _questions(kind: str | None, raw: str | None, phone: str | None, jid_local: str | None) -> list[tuple]:
    """The questions of which any, if a cluster answers it, makes the cluster open to a sender."""
    if kind == "local_user":
        return [("local",)]
    if kind == "phone":
        return [("phone", phone), ("phone", "of jid", None), ("phone", "of jid", phone)]
    if kind == "jid":
        known = [("jid", "of phone", None), ("jid", "of phone", jid_local)] if jid_local else [("jid", "of any")]
        return [("jid", raw), *known]
    if kind == "alias":
        return [("alias",), ("alias", raw)]
    return [("any",)]


class Group:
    """Clusters of one group. Each profile, given in the order of first records, joins the first cluster with all of which it is compatible.

    A local user agrees with no phone, JID or alias; phones and JIDs with those that are equal, a phone with the JID whose local part it is;
    aliases with equal ones; a sender that isn't known, or of another kind, with all. Types agree if equal or not known. The clusters open to a sender
    are found by what they have told, in heaps by place, so a group of any number of senders takes a logarithmic step each.
    """

    def __init__(self):
        self.clusters: list[_Cluster] = []
        self.heaps: dict[tuple, list[int]] = {}

    def _first(self, question: tuple, of: str | None) -> int | None:
        """The first cluster that answers a question, of a type (None: of any)."""
        best = None
        for place in [(*question, "any type")] if of is None else [(*question, "type", None), (*question, "type", of)]:
            heap = self.heaps.get(place, [])
            while heap:
                cluster = self.clusters[heap[0]]
                if question in cluster.places() and (of is None or place[-1] == cluster.type):
                    break
                heappop(heap)  # what a cluster has told is never taken back
            if heap and (best is None or heap[0] < best):
                best = heap[0]
        return best

    def add(self, source, kind, raw, phone, jid_local, message_type, n) -> int:
        of = None if message_type in VAGUE_TYPES else message_type
        found = [k for q in _questions(kind, raw, phone, jid_local) if (k := self._first(q, of)) is not None]
        k = min(found, default=len(self.clusters))
        if k == len(self.clusters):
            self.clusters.append(_Cluster())
            before = set()
        else:
            before = {(p, self.clusters[k].type) for p in self.clusters[k].places()}
        cluster = self.clusters[k]
        cluster.add((source, raw, phone, jid_local), kind, of, n)
        for place in cluster.places():
            if (place, cluster.type) not in before:
                heappush(self.heaps.setdefault((*place, "type", cluster.type), []), k)
                heappush(self.heaps.setdefault((*place, "any type"), []), k)
        return k


#: Rows that the fold sends at once, about: many small groups, or one large one.
SENT_ROWS = 10_000


def _folded(batches):
    """The cluster of each profile with its figures, from batches sorted by group and first record; one group is held at a time beside what is about to be sent. The first profile of a cluster leads it."""
    names = ["group", "status", "group_seq", *PROFILE, "n"]
    types = [pa.binary(), pa.string(), pa.int64(), *[pa.string()] * len(PROFILE), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_()]
    key, rows, done = None, [], []

    def close():
        """Fold the rows of a group."""
        group = Group()
        at = [group.add(*row[3:]) for row in rows]
        sources: list[set] = [set() for _ in group.clusters]
        for k, row in zip(at, rows, strict=True):
            sources[k].add(row[3])
        told = [(c.total, len(s - {None}), c.matched()) for c, s in zip(group.clusters, sources, strict=True)]
        seen = set()
        for k, row in zip(at, rows, strict=True):
            done.append((*row, k, k not in seen, *told[k]))
            seen.add(k)

    def sent():
        columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=[*names, "cluster", "leads", "n_records", "n_sources", "matched"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[0] != key:
                if rows:
                    close()
                if len(done) >= SENT_ROWS:
                    yield sent()
                key, rows = row[0], []
            rows.append(row)
    if rows:
        close()
    if done:
        yield sent()


def duplicate_candidates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, members) of messages with equal trimmed text and time and compatible senders and types.

    records: record_id, seq, source, sender (struct of actor()), stamp (struct), message_type, text. Records are reduced to profiles of a group first (equal source,
    sender and type), so copies of any number are one row; groups of one record go, others are dealt by group once, sorted, and streamed, a group at a time. candidates: candidate_id (numbered by group and
    cluster in the order of first records), n_records, n_sources, confidence: STRONG if of several sources, at a known time, with all senders and types matching, else WEAK. members: record_id, source, candidate_id.
    """
    from .records import numbered

    c = F.col
    told = F.coalesce(F.col("stamp.utc").cast("string"), F.col("stamp.naive").cast("string"))
    key = F.unhex(F.sha2(F.concat_ws("\n", "status", "time", F.trim("text")), 256))
    rows = records.where(has_text(c("text")) & (c("stamp.status") != "ABSENT")).select(
        "record_id", "seq", "source", "message_type", *[F.col(f"sender.{x}").alias(x) for x in PROFILE[1:5]], c("stamp.status").alias("status"), told.alias("time"), "text"
    )
    rows = rows.withColumn("group", key).drop("text", "time")
    each = rows.groupBy("group", "status", *PROFILE).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    # the windows deal groups whole and sort them by first record, which the fold relies on; groups with a single record go before it
    whole = Window.partitionBy("group").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    many = each.withColumns({"_n": F.sum("n").over(whole), "group_seq": F.min("first_seq").over(whole)}).where("_n > 1")
    made = "group binary, status string, group_seq long, " + ", ".join(f"{p} string" for p in PROFILE) + ", n long, cluster int, leads boolean, n_records long, n_sources int, matched boolean"
    folded = many.sortWithinPartitions("group", "first_seq").select("group", "status", "group_seq", *PROFILE, "n").mapInArrow(_folded, made).where("n_records > 1")
    # kept, as ranges are dealt from a sample of what would else be folded twice
    found = kept(folded.where("leads").select("group", "status", "group_seq", "cluster", "n_records", F.col("n_sources").cast("long").alias("n_sources"), "matched"))
    named = numbered(found, ["group_seq", "cluster"], "_k").withColumn("candidate_id", F.concat(F.lit("duplicate_candidate:"), (c("_k") + 1).cast("string")))
    strong = (c("n_sources") > 1) & (c("status") == "KNOWN_UTC") & c("matched")
    same = c("r.group") == c("f.group")
    for p in PROFILE:
        same = same & c(f"r.{p}").eqNullSafe(c(f"f.{p}"))
    members = rows.alias("r").join(folded.join(named.select("group", "cluster", "candidate_id"), ["group", "cluster"]).alias("f"), same).select("r.record_id", "r.source", "f.candidate_id")
    return named.select("candidate_id", "n_records", "n_sources", F.when(strong, "STRONG").otherwise("WEAK").alias("confidence")), members


def with_duplicates(messages: DataFrame, members: DataFrame) -> DataFrame:
    """messages (source, record_id) with duplicate_ids: the candidates that they belong to, sorted as texts; null for none."""
    listed = members.groupBy("source", "record_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("duplicate_ids"))
    return messages.join(listed, ["source", "record_id"], "left")
