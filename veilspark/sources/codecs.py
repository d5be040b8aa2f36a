"""Codecs: mappings and detections as JSON columns, dictionaries and allowlists as YAML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.functions.scalars import fold, normalize

MAPPING = "array<struct<placeholder:string,category:string,surfaces:array<string>,canonical:string,spans:array<struct<start:int,end:int>>>>"
_POSITIONAL = "struct<model:string,detector_version:string,spans:array<array<string>>,not_found:array<array<string>>>"
_ANALYSIS = "struct<text:string,original_text:string,offset_map:array<int>,tokens:array<array<string>>,entities:array<array<string>>>"
ENTRY = "canonical string, category string, aliases array<string>, mask string, partial boolean, case_sensitive boolean, note string"
ALLOW = "surface string, partial boolean, case_sensitive boolean, note string"
#: Section names to categories; the second group is read for old files.
SECTIONS = {"Company": "社名", "Trademark": "商標", "Person": "人名"}
OLD_SECTIONS = {"社名": "社名", "商標": "商標", "人名": "人名", "社員名": "人名"}


def mapping_to_json(mapping: Column) -> Column:
    return F.to_json(mapping)


def mapping_from_json(text: Column) -> Column:
    return F.from_json(text, MAPPING)


def _positional(rows: Column, *fields: str) -> Column:
    """Rows as arrays of their fields in order, texts quoted and numbers not."""
    one = lambda x: F.concat(F.lit("["), F.array_join(F.array(*[_scalar(x[f], f in _NUMBERS) for f in fields]), ","), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, one), ","), F.lit("]"))


_NUMBERS = ("start", "end")


def _scalar(value: Column, number: bool) -> Column:
    if number:
        return F.coalesce(value.cast("string"), F.lit("null"))
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def detection_to_json(spans: Column, not_found: Column, model: Column, version: Column) -> Column:
    """``spans`` (start, end, ene_type, reason, how) and ``not_found`` (ene_type, surface) as positional arrays."""
    head = F.concat(F.lit('{"model":'), _scalar(model, False), F.lit(',"detector_version":'), _scalar(version, False))
    return F.concat(head, F.lit(',"spans":'), _positional(spans, "start", "end", "ene_type", "reason", "how"), F.lit(',"not_found":'), _positional(not_found, "ene_type", "surface"), F.lit("}"))


def detection_from_json(text: Column) -> Column:
    """struct(model, detector_version, spans, not_found) of what ``detection_to_json`` wrote; what is missing is empty."""
    d = F.from_json(text, _POSITIONAL)
    none = F.array().cast("array<array<string>>")
    at = lambda x, k: F.get(x, F.lit(k))
    span = lambda x: F.struct(at(x, 0).cast("int").alias("start"), at(x, 1).cast("int").alias("end"), at(x, 2).alias("ene_type"), at(x, 3).alias("reason"), at(x, 4).alias("how"))
    missing = lambda x: F.struct(at(x, 0).alias("ene_type"), at(x, 1).alias("surface"))
    return F.struct(d["model"].alias("model"), d["detector_version"].alias("detector_version"), F.transform(F.coalesce(d["spans"], none), span).alias("spans"), F.transform(F.coalesce(d["not_found"], none), missing).alias("not_found"))


def analysis_to_json(text: Column, original_text: Column, offset_map: Column, tokens: Column, entities: Column) -> Column:
    """An analysis with ``tokens`` (start, end, surface, tag, pos) and ``entities`` (text, label, start, end) as positional arrays."""
    head = F.concat(F.lit('{"text":'), _scalar(text, False), F.lit(',"original_text":'), _scalar(original_text, False), F.lit(',"offset_map":'), F.to_json(offset_map))
    return F.concat(head, F.lit(',"tokens":'), _positional(tokens, "start", "end", "surface", "tag", "pos"), F.lit(',"entities":'), _positional(entities, "text", "label", "start", "end"), F.lit("}"))


def analysis_from_json(text: Column) -> Column:
    """struct(text, original_text, offset_map, tokens, entities); original text and map may be missing in old rows."""
    d = F.from_json(text, _ANALYSIS)
    none, at = F.array().cast("array<array<string>>"), lambda x, k: F.get(x, F.lit(k))
    token = lambda x: F.struct(at(x, 0).cast("int").alias("start"), at(x, 1).cast("int").alias("end"), at(x, 2).alias("surface"), at(x, 3).alias("tag"), at(x, 4).alias("pos"))
    entity = lambda x: F.struct(at(x, 0).alias("text"), at(x, 1).alias("label"), at(x, 2).cast("int").alias("start"), at(x, 3).cast("int").alias("end"))
    return F.struct(
        d["text"].alias("text"),
        F.coalesce(d["original_text"], F.lit("")).alias("original_text"),
        F.coalesce(d["offset_map"], F.array().cast("array<int>")).alias("offset_map"),
        F.transform(F.coalesce(d["tokens"], none), token).alias("tokens"),
        F.transform(F.coalesce(d["entities"], none), entity).alias("entities"),
    )


def _yaml():
    try:
        import yaml
    except ImportError as e:  # only these four functions need it
        raise RuntimeError("YAML files need PyYAML") from e
    return yaml


def _flag(item: dict, *names: str) -> bool:
    return any(bool(item.get(n)) for n in names)


def read_dictionary(spark: SparkSession, text: str) -> DataFrame:
    """Entries of a YAML dictionary: sections by category, items with canonical, aliases, mask and flags."""
    sections = {k.casefold(): v for k, v in (SECTIONS | OLD_SECTIONS).items()}
    rows = []
    for section, items in (_yaml().safe_load(text) or {}).items():
        category = sections.get(str(section).casefold())
        for item in items or [] if category else []:
            item = item if isinstance(item, dict) else {"canonical": item}
            name = str(item.get("canonical") or "").strip()
            if name:
                aliases = [str(a).strip() for a in item.get("aliases") or [] if str(a).strip()]
                rows.append((name, category, aliases, item.get("mask"), _flag(item, "部分一致", "partial", "embed"), _flag(item, "case_sensitive"), item.get("note")))
    return spark.createDataFrame(rows, ENTRY)


def write_dictionary(entries: DataFrame) -> str:
    """YAML of a dictionary that a person edits: fixed sections first, full keys, sorted by normalised canonical."""
    out: dict[str, list] = {s: [] for s in SECTIONS}
    names = {v: k for k, v in SECTIONS.items()}
    for r in sorted(entries.collect(), key=lambda r: fold(r["canonical"])):
        out.setdefault(names.get(r["category"], r["category"]), []).append({"canonical": r["canonical"], "aliases": list(r["aliases"] or []), "mask": r["mask"] or "", "partial": bool(r["partial"]), "case_sensitive": bool(r["case_sensitive"]), "note": r["note"] or ""})
    return _yaml().safe_dump(out, allow_unicode=True, sort_keys=False)


def read_allowlist(spark: SparkSession, text: str) -> DataFrame:
    rows, seen = [], set()
    for item in _yaml().safe_load(text) or []:
        item = item if isinstance(item, dict) else {"surface": item}
        surface = str(item.get("surface") or "").strip()
        if surface and surface != "nan" and surface not in seen:
            seen.add(surface)
            rows.append((surface, _flag(item, "部分一致", "partial", "embed"), _flag(item, "case_sensitive"), item.get("note")))
    return spark.createDataFrame(rows, ALLOW)


def write_allowlist(entries: DataFrame) -> str:
    rows = sorted(entries.collect(), key=lambda r: fold(r["surface"]))
    return _yaml().safe_dump([{"surface": r["surface"], "partial": bool(r["partial"]), "case_sensitive": bool(r["case_sensitive"]), "note": r["note"] or ""} for r in rows], allow_unicode=True, sort_keys=False)


#: Answers in a column of a term table that mean yes or no, beside the plain ones; all else is unclear and counts as no.
YES, NO = ("true", "1", "yes", "y", "on", "○", "はい"), ("", "false", "0", "no", "n", "off", "×", "いいえ")
FALLBACK = "商標"


def entries_of_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionary entries of table rows (row, term, kind, partial, case_sensitive), and warnings (row, term, about).

    A kind that names no section falls back to trademarks; a flag that is neither yes nor no counts as no. Terms
    without text go. Of terms with the same key the first row stays.
    """
    kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    category = None
    for name, value in (SECTIONS | OLD_SECTIONS).items():
        category = F.when(kind == name.lower(), value) if category is None else category.when(kind == name.lower(), value)
    flag = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    r = rows.where(F.trim(F.coalesce("term", F.lit(""))) != "").select("row", F.trim("term").alias("canonical"), category.alias("named"), flag("partial").alias("p"), flag("case_sensitive").alias("c"))
    known = F.col("named").isNotNull(), F.col("p").isin(*YES, *NO), F.col("c").isin(*YES, *NO)
    about = F.filter(F.array(*[F.when(~ok, F.lit(name)) for ok, name in zip(known, ("kind", "partial", "case_sensitive"))]), lambda x: x.isNotNull())
    warnings = r.select("row", F.col("canonical").alias("term"), F.explode(about).alias("about"))
    first = Window.partitionBy(normalize("canonical")).orderBy("row")
    kept = r.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    none = F.lit(None).cast("string")
    entries = kept.select("canonical", F.coalesce("named", F.lit(FALLBACK)).alias("category"), F.array().cast("array<string>").alias("aliases"), none.alias("mask"), F.col("p").isin(*YES).alias("partial"), F.col("c").isin(*YES).alias("case_sensitive"), none.alias("note"))
    return entries, warnings
