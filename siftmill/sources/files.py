"""Files: schema-checked tables, criteria, run directories, archives and attachments; reports and exports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import sqlite3
import tempfile
import tomllib
import warnings
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds on untrusted archives: files, bytes expanded, bytes per file.
MOST_FILES, MOST_BYTES, FILE_BYTES = 150, 60_000_000, 8_000_000
#: Bounds on previews of attachments: rows, columns, characters a cell, characters in all.
ROWS, COLUMNS, CELL, CHARS = 100, 100, 2_000, 30_000


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header and a declared schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def verified_includes(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The decisions of a run's JSONL file that are includes with a verified quotation."""
    return read_jsonl(spark, path, schema).filter((F.col("decision") == "include") & F.col("span_verified"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV for another tool: nulls as empty cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the declared columns; a missing one or another type fails at once."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} for {f.dataType}" for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("unexpected schema: " + "; ".join(wrong))
    return df.select(*schema.names)


def parse_criteria(content: bytes, sha256: str | None = None) -> dict[str, str]:
    """Criteria by review from TOML; content with another hash is refused; blank entries are left out."""
    found = hashlib.sha256(content).hexdigest()
    if sha256 and found != sha256:
        raise ValueError(f"content has the hash {found}")
    out: dict[str, str] = {}
    for name, entry in tomllib.loads(content.decode("utf-8")).items():
        text = entry.get("criteria") if isinstance(entry, dict) else entry
        if isinstance(text, str) and text.strip():
            out[name] = text.strip()
    return out


def criteria_table(spark: SparkSession, criteria: dict[str, str], source: str) -> DataFrame:
    rows = [(k, v, source, hashlib.sha256(v.encode()).hexdigest()) for k, v in sorted(criteria.items())]
    return spark.createDataFrame(rows, "review string, criteria string, source string, sha256 string")


@dataclass(frozen=True)
class RunConfig:
    """A validated run configuration; its hash is that of the text it came from."""

    name: str
    mode: str
    reviews: tuple[str, ...] = ()
    strategy: str = "bm25"
    recall_target: float = 0.95
    seed: int = 42
    max_records: int | None = None
    config_hash: str = field(default="", compare=False)


def load_config(text: str, known_reviews: set[str] | None = None) -> RunConfig:
    """A configuration from JSON or TOML text; unknown fields, reviews and values are refused."""
    data = json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
    allowed = set(RunConfig.__dataclass_fields__) - {"config_hash"}
    if extra := set(data) - allowed:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    config = RunConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}, config_hash=hashlib.sha256(text.encode()).hexdigest()[:10])
    if config.strategy not in {"random", "bm25", "dense", "hybrid", "rerank"}:
        raise ValueError(f"unknown strategy: {config.strategy}")
    if not 0 < config.recall_target <= 1:
        raise ValueError("recall_target must be in (0, 1]")
    if known_reviews is not None and (unknown := set(config.reviews) - known_reviews):
        raise ValueError(f"unknown reviews: {sorted(unknown)}")
    return config


#: Markers in the names of run directories and the kind they stand for, the first that fits.
RUN_KINDS = [("-gapconsensus-", "gap consensus"), ("-gaprecall-", "gap recall"), ("-typology-", "typology"), ("-ablation-", "ablation"), ("-expand-", "query expansion"), ("-extract-", "extraction"), ("-fulltext-", "full text"), ("-gap-", "gap"), ("asreview-", "external ranking")]


def run_index(spark: SparkSession, directory: str) -> DataFrame:
    """name, kind, schema and raw metrics of every run directory, those without metrics too; on any file system of the cluster."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(directory if ":" in directory else f"file://{os.path.abspath(directory)}")
    fs = root.getFileSystem(conf)
    runs = sorted((s.getPath() for s in fs.listStatus(root) if s.isDirectory()), key=lambda p: p.getName())
    listed = spark.createDataFrame([(p.getName(),) for p in runs], "run string")
    found = [str(p) + "/metrics.json" for p in runs if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "metrics.json"))]
    if found:
        text = spark.read.text(found, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), F.col("value").alias("metrics"))
        listed = listed.join(text, "run", "left")
    else:
        listed = listed.withColumn("metrics", F.lit(None).cast("string"))
    kind = F.lit("screening")
    for marker, name in reversed(RUN_KINDS):
        kind = F.when(F.contains("run", F.lit(marker)) if not marker.startswith("asreview") else F.col("run").startswith(marker), name).otherwise(kind)
    return listed.select("run", kind.alias("kind"), F.get_json_object("metrics", "$.schema").cast("int").alias("schema"), "metrics")


REVIEW_ROW = "review string, n_records bigint, n_included bigint, prevalence double, ranking struct<tnr_at_recall:double,wss_at_recall:double>"


def report_rows(index: DataFrame, schema_version: int = 2) -> DataFrame:
    """A row per run and review of the runs of one schema version; a warning names the runs of others."""
    other = [r["run"] for r in index.filter(F.col("metrics").isNotNull() & ~F.col("schema").eqNullSafe(F.lit(schema_version))).select("run").orderBy("run").collect()]
    if other:
        warnings.warn(f"runs of another schema are left out: {', '.join(other)}", stacklevel=2)
    rows = F.explode(F.from_json(F.get_json_object("metrics", "$.per_review"), f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in REVIEW_ROW.split(', '))}>>"))
    return index.filter(F.col("schema") == schema_version).select("run", "kind", rows.alias("r")).select("run", "kind", "r.review", "r.n_records", "r.n_included", "r.prevalence", F.col("r.ranking.tnr_at_recall").alias("tnr"), F.col("r.ranking.wss_at_recall").alias("wss"))


def write_run(directory: str, parts: dict[str, dict | str]) -> None:
    """A run's artefacts, each a file with line feeds only."""
    os.makedirs(directory, exist_ok=True)
    for name, content in parts.items():
        text = content if isinstance(content, str) else json.dumps(content, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
        with open(os.path.join(directory, name), "w", encoding="utf-8", newline="\n") as file:
            file.write(text)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """Rows as a Markdown table; null cells are a dash, numbers have three decimals."""
    cell = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def external_order(data: bytes) -> list[int]:
    """Record ids in the order an external tool asked for them: table results of a SQLite file in a zip archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        name = next(n for n in archive.namelist() if n.endswith((".sql", ".db", ".sqlite")))
        with tempfile.NamedTemporaryFile(suffix=".db") as file:
            file.write(archive.read(name))
            file.flush()
            with sqlite3.connect(file.name) as db:
                return [r[0] for r in db.execute("SELECT record_id FROM results ORDER BY rowid")]


def preview(data: bytes, suffix: str) -> dict:
    """Text and table of an attachment within the bounds; status tells what could be read."""
    suffix = suffix.lower().lstrip(".")
    out = {"status": "extracted", "text": None, "rows": None, "truncated": False}
    try:
        if suffix in ("csv", "tsv"):
            lines = csv.reader(io.StringIO(data.decode("utf-8-sig")), delimiter="\t" if suffix == "tsv" else ",")
            table = [[c[:CELL] for c in row[:COLUMNS]] for _, row in zip(range(ROWS + 1), lines)]
            return out | {"rows": table[:ROWS], "truncated": len(table) > ROWS}
        if suffix in ("txt", "md", "xml"):
            text = data.decode("utf-8-sig")
            return out | {"text": text[:CHARS], "truncated": len(text) > CHARS}
        if suffix == "json":
            text = json.dumps(json.loads(data), ensure_ascii=False)
            return out | {"text": text[:CHARS], "truncated": len(text) > CHARS}
        if suffix in ("docx", "xlsx"):
            import xml.etree.ElementTree as ET

            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                if suffix == "docx":
                    root = ET.fromstring(archive.read("word/document.xml"))
                    text = "\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p"))
                    return out | {"text": text[:CHARS], "truncated": len(text) > CHARS}
                shared = []
                if "xl/sharedStrings.xml" in archive.namelist():
                    shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ET.fromstring(archive.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
                sheet = ET.fromstring(archive.read(sorted(n for n in archive.namelist() if n.startswith("xl/worksheets/sheet"))[0]))
                table = []
                for row in (r for r in sheet.iter() if r.tag.endswith("}row")):
                    cells = []
                    for c in (c for c in row if c.tag.endswith("}c")):
                        v = next((x.text for x in c.iter() if x.tag.endswith(("}v", "}t"))), None) or ""
                        cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                    table.append([x[:CELL] for x in cells[:COLUMNS]])
                return out | {"rows": table[:ROWS], "truncated": len(table) > ROWS}
    except (ValueError, KeyError, IndexError, zipfile.BadZipFile, UnicodeDecodeError, StopIteration, SyntaxError):
        return out | {"status": "unreadable"}
    return out | {"status": "unsupported"}


ASSET = "path string, name string, size bigint, asset_id string, status string, text string, rows array<array<string>>, truncated boolean"


def archive_assets(spark: SparkSession, path: str) -> DataFrame:
    """The files in zip archives, keyed by the hash of their content, with previews; archives beyond the bounds are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        infos = [i for i in archive.infolist() if not i.is_dir()]
                        if len(infos) > MOST_FILES or sum(i.file_size for i in infos) > MOST_BYTES:
                            rows.append((where, None, len(content), None, "refused", None, None, False))
                            continue
                        for i in infos:
                            if i.file_size > FILE_BYTES:
                                rows.append((where, i.filename, i.file_size, None, "too_large", None, None, False))
                                continue
                            data = archive.read(i)
                            p = preview(data, os.path.splitext(i.filename)[1])
                            rows.append((where, i.filename, len(data), hashlib.sha256(data).hexdigest(), p["status"], p["text"], p["rows"], p["truncated"]))
                except zipfile.BadZipFile:
                    rows.append((where, None, len(content), None, "unreadable", None, None, False))
            yield pd.DataFrame(rows, columns=["path", "name", "size", "asset_id", "status", "text", "rows", "truncated"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ASSET)


def export_project(papers: list[dict], path: str) -> None:
    """A project as a zip archive: a summary, and a folder with a note per paper in its order."""
    buffer = io.StringIO()
    columns = ["rank", "work_id", "title", "relevance"]
    table = csv.DictWriter(buffer, columns, extrasaction="ignore", lineterminator="\n")
    table.writeheader()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for rank, paper in enumerate(papers, 1):
            table.writerow({"rank": rank, **{k: "" if v is None else v for k, v in paper.items()}})
            note = [f"# {paper.get('title') or 'Untitled'}", "", f"- relevance: {paper.get('relevance')}", f"- quotation: {paper.get('evidence_span') or 'not stated'}", ""]
            archive.writestr(f"{rank:03d} {paper.get('folder') or paper['work_id']}/paper.md", "\n".join(note))
        archive.writestr("summary.csv", buffer.getvalue())
