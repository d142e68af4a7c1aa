"""Whole runs: page lists to typed sections, prompts, answers, merged records and formatted tables.

The steps are the operators of this package; inference is any backend (see ``inference``), and its answers are written before
anything else reads them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import inference
from .operators import chunking, classify, merging, nested, sanitize, sectionize, verify
from .session import written
from .sinks import layouts
from .functions.text import period_year
from .sources import files as sources


@dataclass(frozen=True)
class Options:
    """Settings of a run; none names an endpoint or a credential."""

    family: str | None = None
    max_input_tokens: int = 6000
    max_output_tokens: int | None = None
    retries: int = 2
    parallel: int | None = None
    redact: bool = True
    validate: bool = True
    verify: bool = True
    dedup_scope: tuple[str, ...] = ("file_id", "section_no")
    hints: dict = field(default_factory=dict)


def section_texts(files: DataFrame) -> DataFrame:
    """``(file_id, section_no, document_type, text)`` of every section with text."""
    return sectionize.section_texts(files)


def detect(files: DataFrame) -> DataFrame:
    """Detection of each file's whole text, without inference."""
    texts = sectionize.concat_pages(sectionize.pages(files), ["file_id"])
    return classify.detect(texts).drop("text", "scores")


def boundaries(files: DataFrame) -> DataFrame:
    return sectionize.sections(sectionize.pages(files))


def prompts(texts: DataFrame, options: Options = Options()) -> DataFrame:
    """``(file_id, section_no, chunk_index, total_chunks, document_type, family, prompt, max_tokens)``.

    Tax sections go whole, financial ones in chunks. The type is detected from the text; hints by type stand before it.
    """
    d = classify.route_family(classify.detect(texts.drop("document_type")).select("file_id", "section_no", "text", "document_type"), options.family) if options.family else classify.detect(texts.drop("document_type")).withColumn("family", F.when(F.col("document_family") == "unknown", "tax").otherwise(F.col("document_family")))
    # written: three branches read it, and none should run the detection again
    d = written(d.select(F.struct("file_id", "section_no").alias("key"), "text", "document_type", "family"), "sections")
    whole = d.filter("family = 'tax'").select("key", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), "text", F.lit(None).cast("string").alias("account_context"), "document_type", "family")
    cut = chunking.chunk(d.filter("family <> 'tax'"), "key", max_tokens=options.max_input_tokens).drop("tier").join(d.select("key", "document_type", "family"), "key")
    p = chunking.prompt_text(whole.unionByName(cut.select(whole.columns)))
    hint = F.lit("")
    for kind, text in options.hints.items():
        hint = F.when(F.col("document_type") == kind, F.lit(text + "\n")).otherwise(hint)
    return p.select("key.file_id", "key.section_no", "chunk_index", "total_chunks", "document_type", "family", F.concat(inference.instruction(F.col("family"), kind=F.col("document_type")), F.lit("\n"), hint, "prompt").alias("prompt"), inference.token_budget(F.col("document_type"), options.max_output_tokens).alias("max_tokens"))


def extract(files: DataFrame, backend: inference.Backend, options: Options = Options()) -> dict[str, DataFrame]:
    """``partials`` (one answer for each prompt, with errors), ``records`` (one for each section: its partials merged, W-2
    de-duplicated, numbers redacted), ``failed`` (sections without any answer, a placeholder each; those of the financial
    families stand in ``records`` too), ``usage`` and, of statements, ``derived`` fields and, where wanted, ``checks`` of section
    totals, the balance ``equation`` and ``verified``.

    ``n_parts`` of ``total_chunks`` chunks gave what is in a record. The tax year is the record's own, else that of its period,
    else null.
    """
    asked = prompts(section_texts(files), options)
    section = ["file_id", "section_no", "total_chunks", "document_type", "family"]
    keys = [*section, "chunk_index"]
    # a tax form goes whole, so its answer must be whole; a chunk of a statement need not hold all of it
    asked = asked.withColumn("_kind", F.when((F.col("family") == "tax") & F.lit(options.validate), F.col("document_type")))
    partials = inference.infer(asked, backend, keys, retries=options.retries, parallel=options.parallel, kind_col="_kind", redact=options.redact)
    by_doc = partials.withColumn("doc", F.struct("file_id", "section_no"))
    usage = merging.merge_usage(by_doc)
    some = partials.filter("json is not null")
    # a section of one chunk is its answer, and needs no shuffle; both branches read the merged once
    whole = some.filter("total_chunks = 1").select(*section, F.lit(1).cast("long").alias("n_parts"), F.col("json").alias("data"))
    merged = written(whole.unionByName(merging.merge_records(some.filter("total_chunks > 1"), section)), "merged")
    failed = merging.failed_documents(by_doc.select("doc").distinct(), by_doc.filter("json is not null"))
    failed = failed.join(usage, "doc").join(by_doc.groupBy("doc", *section[2:]).agg(F.max_by("error", "chunk_index").alias("error")), "doc").select("doc.*", *section[2:], "entity_name", "calls", "retries", "finish_reason", "error")
    said = F.concat_ws("", F.lit("no chunk gave a result: "), F.col("calls").cast("string"), F.lit(" call(s), "), F.col("retries").cast("string"), F.lit(" retry(ies), last finish_reason "), F.coalesce("finish_reason", F.lit("n/a")))
    empty = F.to_json(F.struct(F.struct(F.col("entity_name").alias("name")).alias("entity"), F.struct(F.array(said).alias("notes")).alias("metadata")))
    placeholders = failed.filter("family <> 'tax'").select(*section, F.lit(0).cast("long").alias("n_parts"), empty.alias("data"))
    section.append("n_parts")
    good = merged.unionByName(placeholders).select(F.xxhash64("file_id", "section_no", F.lit(0)).alias("record_id"), *section, "data")
    if options.redact:
        good = sanitize.redact_records(good, ["data"])
    good = written(good, "records")
    parsed = layouts.parsed(good)
    year = period_year(layouts.at("tax_year"), layouts.at("entity.period_end"), layouts.at("entity.period_start"))
    records = parsed.select("record_id", *section, "data", year.alias("tax_year"), *[layouts.at(p).alias(p.replace(".", "_")) for p in ("employer.ein", "employer.name", "employee.ssn_last4", "employee.name")])
    records = merging.dedup_w2(records, list(options.dedup_scope))
    out = {"partials": partials, "records": records, "failed": failed, "usage": usage}
    statements = parsed.filter("family <> 'tax'")
    if options.verify:
        out |= verified(statements, good.filter("family <> 'tax'"))
    else:
        out["derived"] = verify.derived_fields(statements)
    return out


def verified(parsed: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """``checks, equation, verified, derived`` of statements: parsed, and as ``record_id, data``."""
    n = written(nested.nodes(records), "nodes")
    accounts = nested.typed_table(n, "accounts").select("record_id", F.col("parent_path").alias("path"), verify.account_value(F.col("balance"), F.col("amount")).alias("value"))
    return verify.verify_statements(parsed, nested.typed_table(n, "sections").select("record_id", F.col("node_path").alias("path"), "section_total"), accounts)


def extract_batch(spark, root: str, reader: str, backend: inference.Backend, options: Options = Options(), pattern: str = "*.pdf", **routing) -> dict[str, DataFrame]:
    """``extract`` over all files below ``root``: pages by the registered ``reader``, pages that need it by other readers
    (``sources.gather``); ``errors`` has the files that no reader could read or that hold no text, the rest goes on."""
    found = sources.list_files(spark, root, pattern)
    pages = written(sources.gather(found, reader, **routing), "pages")
    files = pages.filter("error is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages")).select(F.xxhash64("path").alias("file_id"), "path", "pages")
    out = extract(files, backend, options)
    blank = pages.groupBy("path").agg(F.max(F.length(F.trim("text"))).alias("n"), F.first("error", ignorenulls=True).alias("error"))
    out["errors"] = blank.filter("error is not null or coalesce(n, 0) = 0").select("path", F.coalesce("error", F.lit("no text")).alias("error"))
    out["files"] = files.select("file_id", "path")
    return out


def formattable(records: DataFrame) -> DataFrame:
    """The records of a run with the columns that the layouts read; metadata from the record."""
    meta = F.from_json(F.get_json_object("data", "$.metadata"), "is_corrected boolean, is_void boolean, is_summary_sheet boolean, payer_tin_type string, notes array<string>")
    return records.select("record_id", "document_type", "tax_year", "data", meta.alias("metadata"))


def capabilities() -> dict[str, object]:
    """What this installation can do."""
    return {"formats": list(layouts.FORMATS), "ocr_engines": sources.engines(), "families": ["tax", "financial_simple", "financial_multicolumn", "financial_transaction", "financial_reserve"], "sanitize_modes": ["regex", "llm", "hybrid"]}
