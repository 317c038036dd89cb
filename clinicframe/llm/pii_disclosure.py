"""Personal data, and the terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these are the
protected entities. A term near an entity can reveal it although it is no such pattern.
How much it does is measured on the corpus: over all documents, the pointwise mutual
information of term and entity as a share of the entity's information content,
``log(n_both * N / (n_entity * n_term)) / log(N / n_entity)``. It is 1 if the term occurs
nowhere but near the entity and falls to 0 as the term becomes common elsewhere. Copies of
one text are one surrounding, and an estimate from few surroundings is drawn towards 0: a
share counts ``k / (k + SMOOTHING)`` for a term that stands near its entity in ``k`` of
them. From ``GENERALISE_AT`` on a term is replaced by its kind, from ``REMOVE_AT`` on it is
removed, in every document and wherever it stands, within ``WINDOW`` words of a mention or
not; only words that belong to a base span stay with that.

The texts are read three times: for entities with their surroundings; for the number of
documents with each word, which are summed within a task before they move; and for the
spans, where a filter of fixed size picks the words that may be disclosing terms before
anything is joined.

Nulls: a null text is empty; documents without entities get no spans. Repeated rows are
documents of their own. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.llm.common import FILTER_BITS, id_filter, identifier, in_order, stored
from clinicframe.operators.skew import join_grouped
from clinicframe.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone")
WINDOW = 20
#: An entity in one surroundings can have its terms generalised, from three on removed.
SMOOTHING = 0.5
GENERALISE_AT = 0.6
REMOVE_AT = 0.85
#: Distinct words a task counts before it sends them on.
COUNTED_WORDS = 400_000
TRIMMED = ".,;:!?\"'()[]{}<>*|#$%&"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts where its digits start: a match that ends inside them is impossible, and long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from their @ signs, so that long words without one are not tried from every letter."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            # Characters up to here cannot begin an address: none of them reaches a later @ past this one.
            end = at + 1
            at = text.find("@", end)


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(numbers))]
    return sum(doubled) % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in text.split(".")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    out = [("email", *span) for span in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if is_ip(m.group())]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() and 13 <= len(d := digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def entity_name(kind: str, value: str) -> int:
    """One number for the ways of writing an entity."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else "".join(c for c in value if c.isdigit())
    return signed(xxhash.xxh3_64_intdigest(f"{kind}:{plain}"))


def spark_bit(value: int) -> int:
    """The place that ``id_filter`` gives a number: Spark's xxhash64 of a long."""
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), seed=42) & (FILTER_BITS - 1)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def term(word: str) -> str:
    return word.strip(TRIMMED).lower()


def term_name(word: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(word))


def placed_words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]]]:
    """(places of the words, which of them belong to a span, first and last word of each span)."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([w[0] for w in words])
    taken = np.zeros(len(words), bool)
    within = []
    for _, start, end in spans:
        first, last = int(np.searchsorted(starts, start, side="right")) - 1, int(np.searchsorted(starts, end))
        taken[first:last] = True
        within.append((first, last))
    return words, taken, within


def surroundings(text: str, spans: list[tuple[str, int, int]], window: int) -> list[dict]:
    """For each entity of a text: the terms within ``window`` words of a mention, and a name for the surroundings."""
    words, taken, within = placed_words(text, spans)
    near: dict[int, set[int]] = {}
    for (kind, start, end), (first, last) in zip(spans, within):
        near.setdefault(entity_name(kind, text[start:end]), set()).update(range(max(0, first - window), min(len(words), last + window)))
    out = []
    for entity, places in near.items():
        terms = np.unique(np.array([term_name(t) for k in places if not taken[k] if (t := term(text[slice(*words[k])]))], np.int64))
        out.append({"entity": entity, "context": signed(xxhash.xxh3_64_intdigest(terms.tobytes())), "terms": terms.tolist()})
    return out


FOUND = "array<struct<entity:long,context:long,terms:array<long>>>"


def find(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(found): the surroundings of each document's entities, for every document."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [base_spans(t) for t in frame["text"]]
            yield pd.DataFrame({"found": [surroundings(t, s, window) if s else [] for t, s in zip(frame["text"], spans)]})

    return in_order(docs).mapInPandas(look, f"found {FOUND}")


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, n_term): the number of documents with each term, over all documents."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def send() -> pd.DataFrame:
            by_term: Counter[int] = Counter()
            for word, n in held.items():
                by_term[term_name(word)] += n
            return pd.DataFrame({"term": list(by_term), "n": list(by_term.values())})

        for frame in frames:
            for text in frame["text"]:
                held.update({term(w) for w in set(text.split())})
                if len(held) >= COUNTED_WORDS:
                    yield send()
                    held.clear()
        if held:
            yield send()

    counted = in_order(docs).mapInPandas(count, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(found: DataFrame, counts: DataFrame, documents: int) -> DataFrame:
    """(term, share) for the terms that give some entity away from GENERALISE_AT on, with the highest share."""
    # One row per document and entity; copies of one surrounding are summed up before anything else.
    mentions = found.select(F.explode("found").alias("m")).select("m.entity", "m.context", "m.terms")
    per_context = stored(mentions.groupBy("entity", "context").agg(F.count("*").alias("n"), F.first("terms").alias("terms")))
    entities = per_context.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    both = per_context.select("entity", "n", F.explode("terms").alias("term"))
    both = both.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"))
    total = F.lit(float(documents))
    information = F.ln(total / F.col("n_entity"))
    share = F.ln(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term"))) / information * F.col("contexts") / (F.col("contexts") + SMOOTHING)
    known = join_grouped(join_grouped(both, entities, "entity"), counts, "term").filter(information > 0).withColumn("share", share)
    return known.filter(F.col("share") >= GENERALISE_AT).groupBy("term").agg(F.max("share").alias("share"))


def marked_words(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_order, text_name, spans, places) for every document: base spans as kind:start:end, and the words that may be among the terms, by term."""
    filled = id_filter(terms, "term").tobytes()

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int | None] = {}

        def candidate(word: str) -> int | None:
            plain = term(word)
            bit = spark_bit(name := term_name(plain))
            return name if plain and filled[bit >> 3] >> (bit & 7) & 1 else None

        for frame in frames:
            out = []
            for text in frame["text"]:
                spans = base_spans(text)
                candidates: dict[str, int] = {}
                if len(known) >= COUNTED_WORDS:
                    known.clear()
                for word in set(text.split()):
                    if word not in known:
                        known[word] = candidate(word)
                    if known[word] is not None:
                        candidates[word] = known[word]
                places: dict[int, dict] = {}
                if candidates:
                    words, taken, _ = placed_words(text, spans)
                    for k, (a, b) in enumerate(words):
                        name = None if taken[k] else candidates.get(text[a:b])
                        if name is not None:
                            held = places.setdefault(name, {"term": name, "starts": [], "ends": []})
                            held["starts"].append(a)
                            held["ends"].append(b)
                out.append(([f"{k}:{a}:{b}" for k, a, b in spans], list(places.values())))
            yield pd.DataFrame({"doc_order": frame["doc_order"], "text_name": frame["text_name"], "spans": [o[0] for o in out], "places": [o[1] for o in out]})

    texts = in_order(docs).select("doc_order", F.unhex(F.sha2("text", 256)).alias("text_name"), "text")
    return texts.mapInPandas(look, "doc_order long, text_name binary, spans array<string>, places array<struct<term:long,starts:array<int>,ends:array<int>>>")


def spans_of(docs: DataFrame) -> DataFrame:
    """(row, doc_order, text_name, base, added): base spans, and the added ones as structs (action, start, end), for every document."""
    ensure_checkpoint_dir(docs.sparkSession)
    found = stored(find(docs))
    terms = stored(disclosing_terms(found, document_counts(docs), found.count()))
    marked = marked_words(docs, terms).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    places = marked.select("row", F.explode("places").alias("p")).select("row", "p.term", "p.starts", "p.ends")
    # Every word of a row has one term, so the rows of this join are as many as terms of the row.
    hits = places.join(terms, "term")
    action = F.when(F.col("share") >= REMOVE_AT, "remove").otherwise("generalise")
    own = hits.select("row", F.transform(F.arrays_zip("starts", "ends"), lambda p: F.struct(action.alias("action"), p["starts"].alias("start"), p["ends"].alias("end"))).alias("own"))
    added = own.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("added"))
    return marked.select("row", "doc_order", "text_name", F.col("spans").alias("base")).join(added, "row", "left").select(
        "row", "doc_order", "text_name", "base", F.coalesce("added", F.expr("cast(array() as array<struct<action:string,start:int,end:int>>)")).alias("added")
    )


def listed_spans() -> Column:
    """Base spans, then the added ones, as one text."""
    extra = F.transform("added", lambda s: F.concat_ws(":", s["action"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat("base", extra), ",").alias("spans")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans for every document; added spans follow the base ones as generalise and remove."""
    found = spans_of(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select(
        identifier().alias("doc_id"), *[count(k) for k in KINDS],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), listed_spans(),
    )


def general(word: str) -> str:
    """What a term that is only generalised becomes."""
    plain = word.strip(TRIMMED)
    return "[number]" if any(c.isdigit() for c in plain) else "[name]" if plain[:1].isupper() else "[word]"


def clean_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base spans replaced by their kind, terms by theirs or by nothing."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < last:
            continue
        out += [text[last:start], "" if kind == "remove" else general(text[start:end]) if kind == "generalise" else f"[{kind}]"]
        last = end
    return "".join(out) + text[last:]


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with personal data replaced and disclosing terms generalised or removed."""
    # Spans follow from the text, so equal texts have equal ones and a text meets no others'.
    listed = spans_of(docs).groupBy("text_name").agg(F.first(listed_spans()).alias("spans"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_name", F.unhex(F.sha2("text", 256)))
    rows = join_grouped(rows, listed, "text_name")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [[(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)] for s in frame["spans"]]
            yield frame[["doc_id"]].assign(text=[clean_text(t, s) for t, s in zip(frame["text"], spans)])

    return rows.select("doc_id", "text", "spans").mapInPandas(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")
