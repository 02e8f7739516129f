"""License scan by canonical digests. DataFrame operations only.

Canonical form of a text: lower case; copyright lines and the reserving of all rights go,
as do list marks; equivalent spellings become one; all that is not a letter or digit
becomes one space. Its SHA-256 is hash-joined with the digests of known licence texts:
a match is a licence text, whole and alone, whatever its layout and holder.

The same look-up is made for single lines that speak of a licence, against known
one-line notices; the text's own digest decides `license_id`, its lines `notice_ids`.

The known texts and digests are a small table, that of `license_texts` by default, canonicalised by the same
expression; the join broadcasts them only while they are at most BROADCAST_ROWS.

Defined results: null and empty texts, and texts without a letter or digit, have the
digest of the empty string and no licence; texts of any length are read whole; repeated
rows and ids are kept as rows, and each has the notices of all rows of its doc_id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.license_texts import KNOWN, KNOWN_DIGESTS
from quillstone.llm.shared import ASCII_SPACE

BROADCAST_ROWS = 100_000
#: Spellings that licence matching treats as equal, each with the one that is kept.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("noncommercial", "non commercial"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"),
)
#: Lines that may be a notice.
SPEAKS = r"(?i)licen[cs]e|spdx"
#: A line that states a copyright: by a year or a sign, or in a few words that are a paragraph. Other lines may begin with the word where a text was wrapped.
COPYRIGHT = r"(?m)^[^\p{L}\n]*(?:©|(?:copyright|\(c\))[^\n]*(?:\(c\)|©|\b(?:19|20)[0-9][0-9]\b))[^\n]*$"
COPYRIGHT_PARAGRAPH = r"(?:\A|\n[ \t]*\n)[^\p{L}\n]*copyright(?:[ \t]+[^\x20\x09-\x0D]+){1,8}[ \t]*(?:\n[ \t]*\n|\n?\z)"
RESERVED = rf"all[{ASCII_SPACE}]+rights[{ASCII_SPACE}]+reserved"
LIST_MARK = r" \(?(?:[0-9][0-9]?|[a-z])[.)] "


def canonical(text: Column) -> Column:
    """The canonical form; but for copyright lines it doesn't depend on line breaks."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (COPYRIGHT, COPYRIGHT_PARAGRAPH, RESERVED):
        t = F.regexp_replace(t, pattern, "\n\n")
    t = F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), f"[{ASCII_SPACE}]+", "  "), LIST_MARK, " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    spelt = t
    for other, kept in SPELLINGS:
        spelt = F.replace(spelt, F.lit(f" {other} "), F.lit(f" {kept} "))
    t = F.when(t.rlike(f" (?:{'|'.join(o for o, _ in SPELLINGS)}) "), spelt).otherwise(t)
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """(digest, license) of known texts (license, text) and digests (license, digest); of two licences with one text the first by name."""
    found = known.select("license", digest(F.col("text")).alias("digest"))
    found = found.unionByName(digests) if digests else found
    rows = found.count()
    found = found.groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(found) if rows <= BROADCAST_ROWS else found


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, license_id, notice_ids) for every row of docs (doc_id, text), by known texts (license, text) or those of license_texts."""
    make = docs.sparkSession.createDataFrame
    table = known_digests(known) if known is not None else known_digests(make(KNOWN, "license string, text string"), make(KNOWN_DIGESTS, "license string, digest string"))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    rows = rows.select("doc_id", F.col("digest").alias("text_digest"), F.col("license").alias("license_id"))
    lines = docs.where(F.col("text").rlike(SPEAKS)).select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(SPEAKS))).alias("line"))
    notices = lines.select("doc_id", digest(F.col("line")).alias("digest")).join(table, "digest").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notice_ids"))
    return rows.join(notices.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
