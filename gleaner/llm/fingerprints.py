"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line. Its leaves are runs of up to LEAF_CHARS code points that end at
sentence marks, so a change inside a sentence moves no leaf beyond that sentence.
Each paragraph's digest covers its own text (md5); a section is a run of paragraphs
that ends after a blank one or after one whose digest says so (one in eight), which
keeps section borders where they were when paragraphs are inserted elsewhere. Section
digests cover the paragraph digests and the root covers the sections.

The fingerprint is a string ``root|section;section;...`` with sections
``digest:paragraph,paragraph,...`` and paragraphs ``digest.leaf.leaf...`` (hexadecimal).
Roots test equality; where they differ, only branches with differing digests need to
be followed to locate the edit (``changed_paragraphs``). ``likeness`` of two trees is the
Dice coefficient of their distinct leaves (1 for equal roots).

Everything is built-in column functions. Cases: null text is the empty text (one empty
paragraph, no leaf); two trees without leaves have likeness 1; equal texts have equal
fingerprints; very long texts stay within their row, cost linear in their length;
repeated rows and repeated doc_ids stay rows of their own (ordered by row); a table of
one row is its own next document; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, file_row, table
from gleaner.operators.ranking import row_number_within

LEAF_CHARS = 32
_LEAF = r"[^.!?\n]{1,%d}[.!?]*|[.!?]+" % LEAF_CHARS
#: a paragraph digest that starts with one of these ends its section
_SECTION_END = "[01]"


def leaves(text: Column) -> Column:
    """array<int>: the digests of the text's leaves in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_LEAF), F.lit(0)), lambda x: F.hash(x))


def fingerprint(text: Column) -> Column:
    """The whole tree as a string."""

    def paragraph(p: Column) -> Column:
        digest = F.substring(F.md5(p), 1, 16)
        own = F.array_join(F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.hex(F.hash(x).bitwiseAND(0xFFFFFFF))), ".")
        end = (F.trim(p) == "") | digest.rlike("^" + _SECTION_END)
        return F.concat(digest, F.lit("."), own, F.when(end, F.lit(";")).otherwise(F.lit(",")))

    joined = F.rtrim(F.array_join(F.transform(F.split(text, "\n"), paragraph), ""), F.lit(",;"))
    sections = F.transform(F.split(joined, ";"), lambda s: F.concat(F.substring(F.md5(s), 1, 16), F.lit(":"), s))
    # the number of paragraphs belongs to the root: trailing marks are trimmed above
    covered = F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 16)), "")
    root = F.substring(F.sha2(F.concat_ws("/", F.octet_length(text).cast("string"), covered), 256), 1, 32)
    return F.concat(root, F.lit("|"), F.array_join(sections, ";"))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the distinct leaves of two leaf arrays."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Digests of the paragraphs of ``a`` that ``b`` lacks, found below differing sections only."""
    sections = lambda f: F.split(F.substring_index(f, "|", -1), ";")
    open_ = F.array_except(sections(a), sections(b))
    paragraphs = lambda s: F.transform(F.split(F.substring_index(s, ":", -1), ","), lambda p: F.substring_index(p, ".", 1))
    theirs = F.flatten(F.transform(F.array_except(sections(b), sections(a)), paragraphs))
    return F.array_except(F.flatten(F.transform(open_, paragraphs)), theirs)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (see the module's contract).

    Neighbours are found on ids alone (numbered by range, joined on the number). The
    texts are shuffled once by row; what a document needs of the next one, its first
    code points and its leaves, is the only text that travels a second time.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(file_row().alias("_row"), "doc_id", text)
    ids = row_number_within(rows.select("_row", "doc_id", F.char_length("text").cast("long").alias("n_chars")), [], [F.col("doc_id"), F.col("_row")], "_i")
    ids = cut(ids.select("_row", "doc_id", "n_chars", "_i"))
    total = ids.count()
    before = ids.select(F.col("_row").alias("_for"), F.col("doc_id").alias("_doc"), (F.col("n_chars") / 4).cast("long").alias("_need"), (F.col("_i") % max(total, 1) + 1).alias("_i"))
    pairs = ids.select("_row", "_i").join(before, "_i").select("_row", "_for", "_doc", "_need")

    # both joins read the same (row, text) exchange
    texts = rows.select("_row", "text")
    lent = (
        texts.join(pairs.hint("shuffle_hash"), "_row")
        .select("_for", F.col("_doc").alias("doc_id"), "_need", F.left("text", F.col("_need").cast("int")).alias("_lent"), leaves(F.col("text")).alias("_next_leaves"), F.md5("text").alias("_next_md5"))
    )
    n = F.char_length("text")
    joined = texts.join(lent.hint("shuffle_hash"), F.col("_row") == F.col("_for"))
    joined = joined.select(
        "doc_id", n.cast("long").alias("n_chars"), "text", "_next_leaves", "_next_md5",
        F.concat(F.left("text", (n - F.col("_need")).cast("int")), F.col("_lent")).alias("edited"),
        leaves(F.col("text")).alias("_leaves"),
    )
    near = lambda equal, other: F.when(equal, F.lit(1.0)).otherwise(likeness(F.col("_leaves"), other))
    return joined.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        near(F.col("text") == F.col("edited"), leaves(F.col("edited"))).alias("near_edited"),
        near(F.md5("text") == F.col("_next_md5"), F.col("_next_leaves")).alias("near_next"),
    )


def q_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))
