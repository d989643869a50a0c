"""Token budget per source, language and domain, kept up to date by signed deltas.

A ledger is a folder of the shared file system. Every table in it is written once and
never changed; a manifest, committed last by a rename, names the tables that count:

* ``counts`` (content, tokenizer, n_tokens): tokens of every text ever encoded, keyed
  by a 128-bit hash of the text and the hash of the tokenizer; a table per update;
* ``docs``: states of documents, a table per update that holds only the documents it
  changed, with what they were before; the state of the last version counts;
* ``cube`` (tokenizer, source, lang, domain, docs, tokens).

When a kind has more than ``most_parts`` tables they are written as one. A ledger opened
on a folder with a manifest goes on from there, so texts are encoded once for all
sessions; what an interrupted update has written is named nowhere and does no harm.

An update takes delivered rows (several rows of an id are one document: the last by
batch and time, also against what earlier updates delivered). Only texts whose
(content, tokenizer) is not in ``counts`` are encoded. Every document that is new,
changed or removed gives signed rows: minus what the cube held for it, plus what it
holds now; the cube is the old cube plus those rows. A document removed and delivered
again is not encoded again. Joins on texts and documents are shuffled, never broadcast.

A cube belongs to one tokenizer: opening a folder kept with another one raises.

Defined cases: null ids are left out; null and empty texts have 0 tokens and count as
documents; missing or unreadable labels are ``unknown``; spellings of one label are
one label; an update without rows changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.labels import domain_label, lang_label, source_label
from millrace.llm.tokenizers import DEFAULT, count_tokens, encoder, ranks_file, tokenizer_hash
from millrace.session import shared_dir

CELL = ["source", "lang", "domain"]
COUNTS = "content binary, tokenizer string, n_tokens long"
STATE = "content binary, source string, lang string, domain string"
DOCS = f"id string, {STATE}, batch int, at double, tie string, gone boolean, version int, had boolean, old struct<content: binary, source: string, lang: string, domain: string>"
CUBE = "tokenizer string, source string, lang string, domain string, docs long, tokens long"


STATE_COLS = ["content", *CELL, "batch", "at", "tie", "gone"]


class TokenLedger:
    def __init__(self, spark: SparkSession, folder: str | None = None, tokenizer: str = DEFAULT, most_parts: int = 24):
        self.spark, self.name, self.tokenizer, self.most_parts = spark, tokenizer, tokenizer_hash(tokenizer), most_parts
        self.folder = (folder or f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}").rstrip("/")
        self.encoded = 0  # texts encoded by the last update
        self.version, self.tables = 0, {"counts": [], "docs": [], "cube": []}
        self._open()

    def _fs(self, path: str) -> tuple:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _open(self) -> None:
        fs, folder = self._fs(self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        manifests = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not manifests:
            return
        stream = fs.open(self._fs(f"{self.folder}/{manifests[-1]}")[1])
        try:
            told = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        if told["tokenizer"] != self.tokenizer:
            raise ValueError("the ledger was kept with another tokenizer")
        self.version, self.tables = told["version"], told["tables"]

    def _commit(self, tables: dict[str, list[str]]) -> None:
        """The manifest of the next version; a rename makes it whole or not there, and two writers of one version do not both succeed."""
        version = self.version + 1
        body = json.dumps({"version": version, "tokenizer": self.tokenizer, "tables": tables}).encode()
        fs, draft = self._fs(f"{self.folder}/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(body))
        finally:
            stream.close()
        _, final = self._fs(f"{self.folder}/manifest-{version:08d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} of the ledger was written by another update")
        self.version, self.tables = version, tables

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def _known(self, tables: dict[str, list[str]] | None = None) -> DataFrame:
        """(content, n_tokens) of every text encoded."""
        return self._read((tables or self.tables)["counts"], COUNTS).where(F.col("tokenizer") == self.tokenizer).select("content", "n_tokens")

    def _states(self) -> DataFrame:
        """Last state of every document ever seen."""
        rows = self._read(self.tables["docs"], DOCS)
        if len(self.tables["docs"]) <= 1:  # one state a document
            return rows.select("id", *STATE_COLS)
        return rows.groupBy("id").agg(F.max_by(F.struct(*STATE_COLS), "version").alias("s")).select("id", "s.*")

    def _encode(self, texts: DataFrame) -> DataFrame:
        """(content, tokenizer, n_tokens) of (content, text); copies met in a batch are encoded once."""
        raw, mark = self.spark.sparkContext.broadcast(ranks_file(self.name)), self.tokenizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoder(raw.value)
            for batch in batches:
                told: dict[bytes, int] = {}
                texts = batch.column(1)
                for i, content in enumerate(batch.column(0).to_pylist()):
                    if content not in told:
                        told[content] = count_tokens(enc, texts[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.binary()), pa.array([mark] * len(told), pa.string()), pa.array(list(told.values()), pa.int64())], names=["content", "tokenizer", "n_tokens"])

        return texts.mapInArrow(run, COUNTS).groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))

    def update(self, delivered: DataFrame, removed: DataFrame | None = None, complete: bool = False) -> None:
        """``removed``: ids no longer there; ``complete``: ids not among the delivered rows are removed."""
        tables = {kind: list(paths) for kind, paths in self.tables.items()}
        content = F.unhex(F.md5("text"))
        tie = F.md5(F.concat_ws("\x00", F.coalesce(F.hex(content), F.lit("")), *[F.coalesce(F.col(c), F.lit("")) for c in CELL]))
        rows = delivered.where("id IS NOT NULL").select(
            F.col("id").cast("string").alias("id"), content.alias("content"), source_label(F.col("source")).alias("source"), lang_label(F.col("lang")).alias("lang"), domain_label(F.col("domain")).alias("domain"),
            F.struct(F.coalesce(F.col("batch_no").cast("int"), F.lit(-1)).alias("batch"), F.coalesce(F.col("fetched_at").cast("timestamp").cast("double"), F.lit(0.0)).alias("at"), tie.alias("tie")).alias("order"),
        )
        now = rows.groupBy("id").agg(F.max_by(F.struct("content", *CELL, "order"), "order").alias("d")).select("id", "d.content", *[f"d.{c}" for c in CELL], "d.order.batch", "d.order.at", "d.order.tie")

        # states that change, each with what it was
        new = F.struct("content", *CELL).alias("old")
        if tables["docs"]:
            was = self._states().select("id", F.struct("batch", "at", "tie").alias("place"), "gone", new).hint("merge")
            met = now.join(was, "id", "left")
            fresh = met.where(F.col("place").isNull() | F.col("gone") | (F.struct("batch", "at", "tie") >= F.col("place")))
            states = fresh.select("id", "content", *CELL, "batch", "at", "tie", F.lit(False).alias("gone"), (F.col("place").isNotNull() & ~F.col("gone")).alias("had"), "old")
            if complete:
                gone = self._states().where("NOT gone").join(now.select("id").hint("merge"), "id", "left_anti")
            elif removed is not None:
                out = removed.select(F.col("id").cast("string").alias("id")).distinct()
                gone = self._states().where("NOT gone").join(out.hint("merge"), "id", "left_semi").join(now.select("id").hint("merge"), "id", "left_anti")
            else:
                gone = None
            if gone is not None:
                states = states.unionByName(gone.select("id", "content", *CELL, "batch", "at", "tie", F.lit(True).alias("gone"), F.lit(True).alias("had"), new))
        else:
            empty = F.lit(None).cast("struct<content: binary, source: string, lang: string, domain: string>")
            states = now.select("id", "content", *CELL, "batch", "at", "tie", F.lit(False).alias("gone"), F.lit(False).alias("had"), empty.alias("old"))
        docs_at = self._write(states.withColumn("version", F.lit(self.version + 1)).select(*[f.name for f in self._read([], DOCS).schema]), "docs")
        changed = self._read([docs_at], DOCS)

        texts = delivered.where("id IS NOT NULL AND length(text) > 0").select(content.alias("content"), F.col("text").cast("string").alias("text"))
        unseen = texts.join(self._known().select("content").hint("merge"), "content", "left_anti") if tables["counts"] else texts
        counts_at = self._write(self._encode(unseen), "counts")
        self.encoded = self._read([counts_at], COUNTS).count()
        tables["counts"].append(counts_at)

        # what stays the same cancels before it is counted
        signed = changed.where("NOT gone").select("content", *CELL, F.lit(1).alias("sign")).union(changed.where("had").select("old.content", *[f"old.{c}" for c in CELL], F.lit(-1).alias("sign")))
        net = signed.groupBy("content", *CELL).agg(F.sum("sign").alias("sign")).where("sign <> 0")
        deltas = (
            net.join(self._known(tables).hint("merge"), "content", "left")
            .groupBy(*CELL)
            .agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).alias("tokens"))
            .select(F.lit(self.tokenizer).alias("tokenizer"), *CELL, "docs", "tokens")
        )
        merged = self.cube().union(deltas).groupBy("tokenizer", *CELL).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        tables["cube"] = [self._write(merged, "cube")]
        tables["docs"].append(docs_at)
        self._commit(tables)
        self.compact(self.most_parts)

    def compact(self, most_parts: int = 1) -> None:
        """Write the tables of a kind as one if there are more than ``most_parts``."""
        tables = dict(self.tables)
        if len(tables["counts"]) > most_parts:
            tables["counts"] = [self._write(self._read(tables["counts"], COUNTS), "counts")]
        if len(tables["docs"]) > most_parts:
            last = self._states().select("id", *STATE_COLS, F.lit(self.version).alias("version"), F.lit(False).alias("had"), F.lit(None).cast("struct<content: binary, source: string, lang: string, domain: string>").alias("old"))
            tables["docs"] = [self._write(last, "docs")]
        if tables != self.tables:
            self._commit(tables)

    def cube(self) -> DataFrame:
        """Cells (tokenizer, source, lang, domain, docs, tokens)."""
        return self._read(self.tables["cube"], CUBE)

    def totals(self) -> DataFrame:
        """Docs and tokens of every combination of source, lang and domain; null stands for all."""
        return self.cube().where(F.col("tokenizer") == self.tokenizer).cube(*CELL).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def document_tokens(self) -> DataFrame:
        """(id, source, lang, domain, n_tokens)."""
        docs = self._states().where("NOT gone")
        return docs.join(self._known().hint("merge"), "content", "left").select("id", *CELL, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
