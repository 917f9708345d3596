"""The facade: learn, ask, where, check, sleep and save over versioned tables (SRC-01, SNK-04, SNK-05, CV-01, CV-02, AG-18, GR-25)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import check, identity, records, retrieve, store
from cairn.operators import claims as gates
from cairn.session import checkpointed
from cairn.sources import readers

EVIDENCE = "sid string, source string, sentence string"
RECORDS = "record_key long, subject string, predicate string, value string, source string, sources array<string>, level int, trust double, witnesses int, at timestamp, last_seen timestamp, episodic boolean"


class Memory:
    """Evidence lines and records of one store.  Nothing is computed until a result is read."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        versions = self._versions()
        if versions:
            at = f"{path}/{versions[-1]}"
            self.evidence, self.records = spark.read.parquet(f"{at}/evidence"), spark.read.parquet(f"{at}/records")
        else:
            self.evidence, self.records = spark.createDataFrame([], EVIDENCE), spark.createDataFrame([], RECORDS)

    def _files(self):
        """The store's file system, whatever Spark can write to."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        """Names of the whole versions; one that is still being written begins with a dot."""
        if not self.path:
            return []
        _, root, files = self._files()
        names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
        return sorted(n for n in names if not n.startswith((".", "_")))

    def learn(self, what: str | DataFrame, source: str | None = None, at: datetime | None = None) -> dict[str, int]:
        """Read a file, a text or a (doc_id, text, source) table into the store; the counts of what came in."""
        if isinstance(what, DataFrame):
            docs, rows = what, None
        else:
            parts = readers.learned(self.spark, what, source)
            docs = parts.filter("text is not null").select(F.xxhash64("source", "pos", "text").alias("doc_id"), "text", "source")
            rows = parts.filter("row is not null")
        new = store.with_sid(store.deduplicated(store.sentence_rows(docs))).select("sid", "source", "sentence")
        known = self.evidence.select(tx.fold("sentence").alias("f"), F.col("source").alias("s"))
        fresh = new.join(known, (tx.fold(new["sentence"]) == F.col("f")) & (new["source"] == F.col("s")), "left_anti")
        counts = {"evidence": fresh.count(), "facts": 0}
        self.evidence = self.evidence.unionByName(fresh)
        if rows is not None:
            first = F.map_values("row")[0]
            cells = rows.select("source", first.alias("subject"), F.explode("row").alias("predicate", "value")).filter("value <> subject")
            told = cells.select("subject", "predicate", "value", "source", F.lit(4).alias("level"), F.lit(at or datetime(1970, 1, 1)).cast("timestamp").alias("at"))
            self.records = checkpointed(identity.readmitted(self.records, told).select(*self.records.columns))
            # what this reading said, new or witnessed again
            counts["facts"] = told.select("subject", "predicate", "value").distinct().count()
        return counts

    def learn_cell(self, subject: str, predicate: str, value: str, source: str, at: datetime | None = None) -> None:
        """SRC-21: one fact by its three names."""
        row = [(subject, predicate, value, source, 4, at or datetime(1970, 1, 1))]
        told = self.spark.createDataFrame(row, "subject string, predicate string, value string, source string, level int, at timestamp")
        kept = told.filter("trim(subject) <> '' and trim(predicate) <> '' and trim(value) <> '' and subject <> value")
        self.records = checkpointed(identity.readmitted(self.records, kept).select(*self.records.columns))

    def ask(self, questions: DataFrame, most: int = 6) -> DataFrame:
        """CV-01: (query_id, answer, sources, proof, kind, coverage, abstained, from_graph) for (query_id, query).

        A record where exactly one is meant, else a count of sources, else the best line that carries the question; else nothing is said.
        """
        cells = self.records.select(F.col("subject").alias("entity"), F.col("predicate").alias("field"), "value")
        return gates.answered(self.evidence, questions, cells, most).withColumn("from_graph", F.coalesce(F.col("kind") == "record", F.lit(False)))

    def about(self, subject: str) -> DataFrame:
        """JN-05: the records of a subject."""
        return identity.about(self.records, subject)

    def where(self, term: str) -> DataFrame:
        return retrieve.where(self.evidence, term)

    def check(self, answers: DataFrame, answer: str, evidence: str, question: str | None = None) -> DataFrame:
        return check.check(answers, answer, evidence, question)

    def sleep(self, now: datetime) -> None:
        """Settle, fade and arbitrate once; the clock is given."""
        rested = records.slept(self.records, F.lit(now)).withColumns({"trust": F.col("new_trust"), "episodic": F.col("now_episodic")}).drop("new_trust", "now_episodic")
        self.records = records.arbitrated(rested).withColumn("trust", F.col("new_trust")).select(*self.records.columns)

    def run_mind(self, now: datetime, most: int = 200) -> list[str]:
        """GR-25: resolve where there is tension, derive what transitive predicates imply, sleep; again until nothing changes, at most so many steps."""
        done: list[str] = []
        while len(done) < most:
            before = self._state()
            if not records.pressure(self.records).isEmpty():
                self.records = checkpointed(records.arbitrated(self.records).withColumn("trust", F.col("new_trust")).select(*self.records.columns))
                done.append("resolve")
            new = identity.derived(self.records)
            if not new.isEmpty():
                made = new.withColumns({
                    "record_key": F.xxhash64("subject", "predicate", "value"), "source": F.lit(identity.INFERENCE), "sources": F.array(F.lit(identity.INFERENCE)),
                    "witnesses": F.lit(1), "at": F.lit(now).cast("timestamp"), "last_seen": F.lit(now).cast("timestamp"), "episodic": F.lit(True)})
                self.records = checkpointed(self.records.unionByName(made.select(*self.records.columns)))
                done.append("derive")
            if not done or before == self._state():
                break
        self.sleep(now)
        return [*done[: most - 1], "sleep"]

    def _state(self) -> tuple:
        """Count and summed trust, the fingerprint of a state."""
        return tuple(self.records.agg(F.count(F.lit(1)), F.round(F.sum("trust"), 6)).first())

    def status(self) -> DataFrame:
        return records.status(self.records, self.records.select(F.col("subject").alias("identity_key")).distinct())

    def save(self) -> str:
        """Write a new version beside the old ones; a reader sees the last whole one."""
        if not self.path:
            raise ValueError("the memory has no path")
        jvm, root, files = self._files()
        name = f"{len(self._versions()):08d}"
        part = f"{self.path}/.{name}"
        self.evidence.write.mode("overwrite").parquet(f"{part}/evidence")
        self.records.write.mode("overwrite").parquet(f"{part}/records")
        if not files.rename(jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")):
            raise OSError(f"version {name} of {self.path} exists already")
        return name
