"""Visually identical text with different characters: one consistent form, and groups of look-alikes.

The form is a confusables skeleton: decompose the text, replace every character by its prototype, and
decompose again. Prototypes come from rules over the character database (full-width and half-width forms,
mathematical letters and digits, ligatures, blanks, characters of no width) and, for letters, from the
published table of confusable characters, as the ICU library that comes with Spark holds it
(``confusables``); those of a short table of the commonest go before it. Only letters whose
prototype is one plain Latin letter are replaced: the published table also joins 0 and O, or 1, l and I,
which TESTDATA keeps apart, as it does accents, case, digits, punctuation and line breaks.

Defined results: a null text, and a text without any visible character, has no form (null); exact copies
share their form; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spangraph.session import written

# Letters of other alphabets, each followed by the Latin letter that it looks like.
LOOK_ALIKES = (
    "Аa аa Вb Еe еe Кk Мm Нh Оo оo Рp рp Сc сc Тt уy Хx хx Ѕs ѕs Іi іi Јj јj һh ԁd ԛq ԝw "  # Cyrillic
    "Αa Βb Εe Ζz Ηh Ιi Κk Μm Νn Οo οo Ρp Τt Υy Χx "  # Greek
    "օo"  # Armenian
)
#: Format characters that do show, and other characters that do not.
VISIBLE_FORMAT = {chr(c) for c in (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)}
NO_WIDTH = {chr(c) for c in (0x34F, 0x180B, 0x180C, 0x180D, *range(0xFE00, 0xFE10))}


SHORT = {a: b.upper() if a.isupper() else b for a, b in LOOK_ALIKES.split()}


class _Prototypes(dict):
    """Character to prototype, worked out once for each character met."""

    def __init__(self) -> None:
        super().__init__(SHORT)
        self.letters: Mapping[str, str] = {}

    def learn(self, letters: Mapping[str, str]) -> None:
        """Takes over the published prototypes of letters; those of the short table stay."""
        if letters and not self.letters:
            self.letters = letters
            self.clear()
            self.update(SHORT)

    def __missing__(self, ch: str) -> str:
        kind, parts = unicodedata.category(ch), unicodedata.decomposition(ch)
        out = ch
        if ch in NO_WIDTH or (kind == "Cf" and ch not in VISIBLE_FORMAT):
            out = ""
        elif kind == "Zs":
            out = " "
        elif parts.startswith(("<wide>", "<narrow>", "<font>")) or (parts.startswith("<compat>") and "LIGATURE" in unicodedata.name(ch, "")):
            out = unicodedata.normalize("NFKC", ch)
        elif kind[0] == "L":
            out = self.letters.get(ch, ch)
        self[ch] = out
        return out


PROTOTYPES = _Prototypes()


def learn(letters: Mapping[str, str]) -> None:
    """Gives the table of this process the published prototypes; tasks call it first."""
    PROTOTYPES.learn(letters)


def confusables(spark: SparkSession) -> dict[str, str]:
    """The published prototype of every letter outside ASCII that looks like one Latin letter.

    Read from ICU's confusables data in one call. The table has a few thousand entries, whatever the texts,
    and travels with the tasks. Where the published prototype stands for I and l alike, a capital or
    caseless letter is taken for I and a small one for l. Raises where the session has no ICU or ICU fails, since
    without the table look-alike texts would be missed unseen.
    """
    letters = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFD", c) == c]
    try:
        checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
        shown = checker.getSkeleton("\n".join(letters)).split("\n")
    except Exception as e:
        raise RuntimeError("the session has no JVM with ICU, which holds the published look-alike letters") from e
    if len(shown) != len(letters):
        raise RuntimeError(f"ICU gave {len(shown)} prototypes for {len(letters)} letters")
    out = {c: p for c, p in zip(letters, shown) if len(p) == 1 and p.isascii() and p.isalpha() and p != c}
    return {c: "I" if p == "l" and not c.islower() else p for c, p in out.items()}


def skeleton(text: str) -> str:
    """The consistent form of a text, decomposed."""
    out = unicodedata.normalize("NFD", text)
    if out.isascii():
        return out
    for ch in set(out):
        to = PROTOTYPES[ch]
        if to != ch:
            out = out.replace(ch, to)
    return unicodedata.normalize("NFD", out)


def visible(text: str) -> bool:
    return any(not ch.isspace() and unicodedata.category(ch) not in ("Cc", "Cf") for ch in text)


def forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form): the consistent form of each text, composed."""

    letters = confusables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn(letters)
        for batch in batches:
            made = [unicodedata.normalize("NFC", s) if t is not None and visible(s := skeleton(t)) else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "form"])

    ids = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return ids.mapInArrow(run, "doc_id long, form string")


def form_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, form_key): digests of the stored text and of its form; texts without a form are left out.

    Only the digests leave the tasks; the texts are neither shuffled nor returned.
    """

    letters = confusables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn(letters)
        for batch in batches:
            keys = [
                hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() if t is not None and visible(s := skeleton(t)) else None
                for t in batch.column(2).to_pylist()
            ]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["doc_id", "text_key", "form_key"])
            yield out.filter(out.column(2).is_valid())

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return ids.mapInArrow(run, "doc_id long, text_key long, form_key binary")


def look_alike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts stored in different characters that have the same form.

    Pairs are made of the distinct texts of a form and only then spread to the documents of either text, so
    the rows joined are those of the result. Forms with one text, however many copies, meet no partner.
    """
    keys = written(form_keys(docs, doc_id, text), "forms")
    # forms of one text go by a minimum and a maximum, before their documents are told apart
    mixed = keys.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo < hi").select("form_key")
    of_form = keys.join(mixed, "form_key", "left_semi").select("form_key", "text_key").distinct()
    pairs = of_form.withColumnRenamed("text_key", "key_a").join(of_form.withColumnRenamed("text_key", "key_b"), "form_key").where("key_a < key_b")
    one = keys.select("form_key", F.col("text_key").alias("key_a"), F.col("doc_id").alias("one"))
    other = keys.select("form_key", F.col("text_key").alias("key_b"), F.col("doc_id").alias("other"))
    found = pairs.join(one, ["form_key", "key_a"]).join(other, ["form_key", "key_b"])
    # a document that is stored twice in different characters is no pair of two documents
    return found.where("one <> other").select(F.least("one", "other").alias("doc_a"), F.greatest("one", "other").alias("doc_b"))


def form_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_docs, n_texts): the class is the least doc_id with the same form."""
    keys = written(form_keys(docs, doc_id, text), "forms")
    texts = keys.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = texts.groupBy("form_key").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts")
    )
    return keys.join(classes, "form_key").select("doc_id", "class_id", "n_docs", "n_texts")
