"""Topics of a document's parts brought together in the order in which they were found."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import OPPOSED_STEMS, bare_description, bare_label, canonical_label, domain_stems, label_numbers, normalized_label

#: The longest description, and the longest labels that may take the place of one with fewer stems, or with as many.
DESCRIPTION, MORE_STEMS, AS_MANY_STEMS = 300, 55, 45
_OPPOSED = [(frozenset(a), frozenset(b)) for a, b in OPPOSED_STEMS]
_IN = ["document_id", "chunk", "label", "description", "key", "numbers", "label_stems", "text_stems", "evidence_ids"]
RESULT = "place int, label string, description string, evidence_ids array<string>, support int, n_found int, n_topics int"


def _opposite(a: set, b: set) -> bool:
    return any(a & x and b & y or a & y and b & x for x, y in _OPPOSED)


class Topic:
    """A topic as told by the ones brought together so far.

    numbers are those of its first label, own_numbers those of the label in use; label_stems are those of all labels taken for it, own_stems of the one in use, told_stems of the description in use.
    """

    __slots__ = ("key", "label", "description", "numbers", "own_numbers", "label_stems", "own_stems", "told_stems", "stems", "evidence", "known", "chunks", "first")

    def __init__(self, key, label, description, numbers, label_stems, text_stems, evidence, chunk, first):
        self.key, self.label, self.description, self.numbers, self.own_numbers, self.first = key, label, description, numbers, numbers, first
        self.own_stems, self.told_stems = set(label_stems), set(text_stems)
        self.label_stems, self.stems = set(label_stems), set(label_stems) | set(text_stems)
        self.evidence, self.known, self.chunks = list(evidence), set(evidence), {chunk}

    def cite(self, evidence) -> None:
        for e in evidence:
            if e not in self.known:
                self.known.add(e)
                self.evidence.append(e)

    def describe(self, description: str, stems: set) -> None:
        """Take a longer description, unless it is too long."""
        if len(self.description) < len(description) <= DESCRIPTION:
            self.description, self.told_stems = description, stems

    def like(self, numbers: tuple, label_stems: set, stems: set, known: set) -> bool:
        """Whether a topic of other words is this one: equal numbers, no opposite actions, and evidence and a stem of the labels in common (or two stems at all), or two
        stems of the labels that are half or more of both."""
        if numbers != self.numbers or not self.stems or _opposite(label_stems, self.label_stems):
            return False
        shared = len(label_stems & self.label_stems)
        if known & self.known and (shared or len(stems & self.stems) >= 2):
            return True
        return shared >= 2 and 2 * shared >= len(label_stems | self.label_stems)


class Fold:
    """The topics of one document. Each new one joins the topic of its canonical label, else the first that it is like, else it is one of its own.

    Topics are found by their stems: two that are alike share one, so only those with a stem in common are looked at.
    """

    def __init__(self):
        self.topics: dict[str, Topic] = {}
        self.by_stem: dict[str, dict[str, None]] = {}
        self.found = 0

    def _index(self, topic: Topic) -> None:
        for stem in topic.stems:
            self.by_stem.setdefault(stem, {})[topic.key] = None

    def _first_like(self, numbers, label_stems: set, stems: set, known: set, before: int | None = None, not_key: str | None = None) -> Topic | None:
        keys = {k for s in stems for k in self.by_stem.get(s, ()) if k in self.topics and k != not_key}
        for topic in sorted((self.topics[k] for k in keys), key=lambda t: t.first):
            if before is not None and topic.first >= before:
                break
            if topic.like(numbers, label_stems, stems, known):
                return topic
        return None

    def add(self, chunk, label, description, key, numbers, label_stems, text_stems, evidence) -> None:
        self.found += 1
        own, told = set(label_stems), set(text_stems)
        topic = self.topics.get(key) or (self._first_like(tuple(numbers), own, own | told, set(evidence)) if own | told else None)
        if topic is None:
            topic = self.topics[key] = Topic(key, label, description, tuple(numbers), own, told, evidence, chunk, self.found)
            return self._index(topic)
        topic.chunks.add(chunk)
        topic.cite(evidence)
        topic.stems |= own | told
        topic.describe(description, told)
        more = len(own) - len(topic.label_stems)
        if more > 0 and len(label) <= MORE_STEMS or more == 0 and len(topic.label) < len(label) <= AS_MANY_STEMS:
            topic.label, topic.label_stems, topic.own_stems, topic.own_numbers = label, set(own), set(own), tuple(numbers)
        else:
            topic.label_stems |= own
        self._index(topic)

    def close(self) -> None:
        """Bring together topics that others have made alike: the last one that is like an earlier one joins it, again and again until none is."""
        again = True
        while again and len(self.topics) > 1:
            again = False
            for topic in sorted(self.topics.values(), key=lambda t: -t.first)[:-1]:
                stems = topic.own_stems | topic.told_stems
                home = self._first_like(topic.own_numbers, topic.own_stems, stems, topic.known, topic.first, topic.key) if stems else None
                if home is None:
                    continue
                home.chunks |= topic.chunks
                home.cite(topic.evidence)
                home.stems |= topic.stems
                home.label_stems |= topic.label_stems
                home.describe(topic.description, topic.told_stems)
                del self.topics[topic.key]
                self._index(home)
                again = True
                break

    def ranked(self, most: int) -> list[Topic]:
        """All topics in the order found, or if they are too many those with most parts, then most evidence, then found first, then by key."""
        order = sorted(self.topics.values(), key=lambda t: t.first)
        if len(order) <= most:
            return order
        return sorted(order, key=lambda t: (-len(t.chunks), -len(t.evidence), t.first, t.key))[:most]


def consolidated(topics: DataFrame, most: int = 10) -> DataFrame:
    """(document_id, place, label, description, evidence_ids, support, n_found, n_topics): topics (document_id, chunk, topic_no, label, description, evidence_ids) brought together.

    In the order of chunk and topic_no, equal canonical labels first, else by stems, numbers and evidence; a longer description and a label that says more take the place of
    others; topics linked by those brought together join in the end. place counts from 1; support is the number of parts, n_found of all topics given, n_topics of those
    brought together, of which at most `most` are told. A document streams past its task in order, which holds its topics as brought together so far. Null texts are empty.
    """
    c = F.col
    empty = lambda x: F.coalesce(x, F.lit(""))
    label, description = bare_label(empty(c("label"))), bare_description(empty(c("description")))
    named = topics.select("document_id", "chunk", "topic_no", label.alias("label"), description.alias("description"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))
    some = lambda x: F.nullif(x, F.lit(""))
    key = F.coalesce(some(canonical_label(c("label"))), some(normalized_label(c("label"))), F.lower("label"))
    rows = named.select(
        "document_id", "chunk", "topic_no", "label", "description", key.alias("key"), label_numbers(c("label")).alias("numbers"), domain_stems(c("label")).alias("label_stems"),
        domain_stems(c("description")).alias("text_stems"), "evidence_ids",
    )
    schema = f"document_id {topics.schema['document_id'].dataType.simpleString()}, {RESULT}"
    kind = pa.string()

    def run(batches):
        fold, document, out = None, None, []

        def told():
            fold.close()
            found = fold.ranked(most)
            return [(document, n, t.label, t.description, t.evidence, len(t.chunks), fold.found, len(fold.topics)) for n, t in enumerate(found, 1)]

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            types = [kind, pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["document_id", *[p.split()[0] for p in RESULT.split(", ")]])

        for batch in batches:
            kind = batch.schema.field("document_id").type
            for name, *row in zip(*(batch.column(x).to_pylist() for x in _IN), strict=True):
                if fold is None or name != document:
                    out += told() if fold else []
                    fold, document = Fold(), name
                fold.add(*row)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        out += told() if fold else []
        if out:
            yield batch_of(out)

    return rows.repartition("document_id").sortWithinPartitions("document_id", "chunk", "topic_no").select(*_IN).mapInArrow(run, schema)
