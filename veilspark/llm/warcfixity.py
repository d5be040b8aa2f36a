"""Operator 6: Merkle fixity audit of WARC archives, in DataFrame functions.

Pages become WARC resource records; an archive holds the records of ID_RANGE consecutive page ids in order of id,
and a record's offset is the length of all before it. A record's hash is a leaf; FANOUT consecutive nodes with their
offset ranges are hashed into a node above, up to one root an archive. An audit compares two replicas' roots and
then, level by level, only the children of nodes that differ. Where leaves differ, the records of both replicas are
aligned, first by id and hash, then by id, so that a record that only moved, since one before it was lost, added or
grew, stays intact. After such a record the descent reaches all later leaves of its archive.

A null html is an empty body, a null url an empty URI. Pages without id have archives by content, by a hash of 31 bits.
Repeated rows are repeated records; equal ids are ordered by hash. Records that only one replica has are returned as
missing (ours) or extra (theirs); a record without id that changed is one of each. An empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import written

ID_RANGE = 1000
FANOUT = 16
END_OF_RECORD = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC record, as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END_OF_RECORD),
        body,
        F.lit(END_OF_RECORD),
    )


def leaves(pages: DataFrame, altered: Column | None = None, longer: Column | None = None) -> DataFrame:
    """Per record: page_id, archive, seq, offset, length, sha256.

    ``altered`` and ``longer``, if given, mark pages whose last record byte a replica holds wrong, or followed by
    another one (for drills and tests).
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    if altered is not None:
        text = F.when(altered, F.concat(F.substring(text, 1, F.length(text) - 1), F.lit("\t"))).otherwise(text)
    if longer is not None:
        text = F.when(longer, F.concat(text, F.lit("\t"))).otherwise(text)
    archive = F.coalesce(F.floor(F.col("page_id") / ID_RANGE).cast("bigint"), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 31)))
    rows = pages.select("page_id", archive.alias("archive"), text.alias("record"))
    rows = rows.select("page_id", "archive", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("sha256"))
    w = Window.partitionBy("archive").orderBy("page_id", "length", "sha256")
    before = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return rows.select("page_id", "archive", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), before.alias("offset"), "length", "sha256")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots: archive, seq, offset, length, sha256."""
    levels = [leaf.select("archive", "seq", "offset", "length", "sha256")]
    most = (leaf.agg(F.max("seq")).first()[0] or 0) + 1
    while most > 1:
        part = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha256")
        child = levels[-1].select("archive", F.floor(F.col("seq") / FANOUT).cast("bigint").alias("up"), "seq", "offset", "length", part.alias("part"))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"])
        node = child.groupBy("archive", F.col("up").alias("seq")).agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sha2(F.concat_ws("|", parts), 256).alias("sha256"))
        levels.append(node)
        most = -(-most // FANOUT)
    return levels


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(archive, seq) of the leaves that differ, found from the roots down; both trees must be of equal height."""
    bad = None
    for mine, other in zip(reversed(ours), reversed(theirs)):
        if bad is not None:
            above = bad.select("archive", F.col("seq").alias("up"))
            mine, other = (x.withColumn("up", F.floor(F.col("seq") / FANOUT).cast("bigint")).join(above, ["archive", "up"], "left_semi") for x in (mine, other))
        a = mine.select("archive", "seq", F.struct("offset", "length", "sha256").alias("a"))
        b = other.select("archive", "seq", F.struct("offset", "length", "sha256").alias("b"))
        bad = a.join(b, ["archive", "seq"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("archive", "seq")
    return bad


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The records of both replicas with ``status`` and ``intact``, at our places, or at theirs where only they have one.

    intact: the other replica holds the same bytes; damaged: it holds other bytes under the id; missing: it holds no
    such record; extra: only it holds the record.
    """
    ours, theirs = written(ours, "leaves"), written(theirs, "leaves")
    trees = [tree(ours), tree(theirs)]
    height = max(map(len, trees))
    for t in trees:  # the lower tree's roots are hashed on, alone, to the height of the other
        while len(t) < height:
            t.append(t[-1].select("archive", F.floor(F.col("seq") / FANOUT).cast("bigint").alias("seq"), "offset", "length", F.sha2("sha256", 256).alias("sha256")))
    bad = written(differing(*trees), "differing")
    return ours.join(bad, ["archive", "seq"], "left_anti").select(*_RECORD, F.lit("intact").alias("status"), F.lit(True).alias("intact")).unionByName(
        _aligned(*(x.join(bad, ["archive", "seq"], "left_semi") for x in (ours, theirs)))
    )


_RECORD = ("page_id", "archive", "offset", "length", "sha256")


def _aligned(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The leaves of differing branches, matched as bags: equal records one to one, then those left by their id."""
    both = ours.withColumn("mine", F.lit(True)).unionByName(theirs.withColumn("mine", F.lit(False)))

    def paired(df: DataFrame, *key: str) -> DataFrame:
        nth = df.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "mine").orderBy("seq")))
        return nth.withColumn("pair", F.count(F.lit(1)).over(Window.partitionBy(*key, "nth")) == 2)

    same = paired(both, "archive", "page_id", "length", "sha256").withColumn("same", F.col("pair"))
    told = paired(same, "archive", "page_id", "same")
    kept = told.where(F.col("mine") | ~(F.col("same") | (F.col("pair") & F.col("page_id").isNotNull())))
    status = F.when(F.col("same"), "intact").when(F.col("pair") & F.col("page_id").isNotNull(), "damaged").when(F.col("mine"), "missing").otherwise("extra")
    return kept.select(*_RECORD, status.alias("status"), F.col("same").alias("intact"))


def _replica(pages: DataFrame, every: int) -> DataFrame:
    """A replica in which each ``every``-th page's record is, in turn, altered in a byte, lost, or longer by one."""
    hit = F.coalesce(F.col("page_id") % every == 0, F.lit(False))
    kind = F.pmod(F.floor(F.col("page_id") / every), F.lit(3))
    return leaves(pages.where(~(hit & F.coalesce(kind == 1, F.lit(False)))), hit & (kind == 0), hit & (kind == 2))


def drill(pages: DataFrame, every: int = 97) -> DataFrame:
    """A fixity drill: audit the archives against a replica in which each ``every``-th page's record is damaged."""
    return audit(leaves(pages), _replica(pages, every)).drop("status")


def drill_both(pages: DataFrame, every: int = 97) -> DataFrame:
    """The same drill, where our side has also lost records: each ``every``-th but one, which the replica still has."""
    lost = F.coalesce(F.col("page_id") % every == 1, F.lit(False))
    return audit(leaves(pages.where(~lost)), _replica(pages, every))


ORACLE = r"""
WITH r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
 || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
 || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages),
l AS (SELECT page_id, CAST(floor(page_id / 1000) AS BIGINT) AS archive, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256 FROM r)
SELECT page_id, archive, CAST(sum(length) OVER (PARTITION BY archive ORDER BY page_id, length, sha256 ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset", length, sha256, page_id % 97 <> 0 AS intact FROM l
"""
