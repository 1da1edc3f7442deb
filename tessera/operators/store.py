"""Keyed tables: merges, flag updates, chats, unique slugs, versioned storage."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str], replace: list[str] = (), created: str | None = None) -> DataFrame:
    """Full merge of ``new`` into ``old``, one row per key, with an ``action`` (created, updated or kept).

    ``keep_old`` columns are overwritten only by values that are neither null nor empty, ``replace`` columns by
    any value of the new row. ``created`` keeps its first value. Both sides have one row per key.
    """
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in [*keep_old, *replace, *([created] if created else [])]], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in [*keep_old, *replace, *([created] if created else [])]], F.lit(True).alias("_n"))
    j = o.join(n, keys, "full_outer")
    kinds = dict(new.dtypes)

    def truthy(c: str) -> Column:
        value = F.col(f"_n_{c}")
        return F.when(value != "", value) if kinds[c] == "string" else F.when(F.size(value) > 0, value) if kinds[c].startswith(("array", "map")) else value

    merged = [F.coalesce(truthy(c), F.col(f"_o_{c}")).alias(c) for c in keep_old]
    merged += [F.when(F.col("_n"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in replace]
    if created:
        merged.append(F.coalesce(f"_o_{created}", f"_n_{created}").alias(created))
    action = F.when(F.col("_o").isNull(), "created").when(F.col("_n"), "updated").otherwise("kept")
    return j.select(*keys, *merged, action.alias("action"))


def set_flag(rows: DataFrame, ids: DataFrame, key: str, flag: str, value: bool = True) -> DataFrame:
    """``flag`` set on the rows whose key is among ``ids``; all other columns as they were."""
    marked = ids.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return rows.join(marked, F.col(key) == F.col("_k"), "left").withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag))).drop("_k", "_hit")


def new_documents(rows: DataFrame) -> DataFrame:
    """``rows`` as they are inserted: up to date and not being worked on."""
    return rows.withColumns({"needs_sync": F.lit(False), "is_updating": F.lit(False)})


def cleared(rows: DataFrame, payload: DataFrame, key: str, *fields: str) -> DataFrame:
    """``rows`` with both flags off where ``payload`` has their key, and ``fields`` from it where it gives a value."""
    p = payload.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    j = rows.join(p, F.col(key) == F.col("_k"), "left")
    flags = {f: F.when(F.col("_hit"), F.lit(False)).otherwise(F.col(f)) for f in ("needs_sync", "is_updating")}
    return j.withColumns(flags | {f: F.coalesce(f"_p_{f}", f) for f in fields}).drop("_k", "_hit", *[f"_p_{f}" for f in fields])


def listed(rows: DataFrame, *keys: str, **known: str) -> DataFrame:
    """The rows with all of the ``known`` values; the text columns ``keys`` without nulls."""
    for name, value in known.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.withColumns({k: F.coalesce(k, F.lit("")) for k in keys})


def looked_up(collections: DataFrame, organizations: DataFrame, repositories: DataFrame) -> DataFrame:
    """(collection, organization, repository, error) by short id and repository token; the first side that is missing is the error."""
    j = collections.join(organizations, "short_id", "left").join(repositories, ["short_id", "token"], "left")
    error = F.when(F.col("organization").isNull(), "organization not found").when(F.col("repository").isNull(), "repository not found")
    return j.select("collection", "organization", "repository", error.alias("error"))


def active_token(repos: DataFrame, users: DataFrame, organizations: DataFrame) -> DataFrame:
    """(repo_id, token, source): of the user who added the repository, else of the organisation's owner; active and not blank only."""
    usable = users.where((F.col("status") == "active") & (F.trim(F.coalesce("token", F.lit(""))) != "")).select(F.col("user_id").alias("_u"), "token")
    adder = usable.select(F.col("_u").alias("added_by"), F.col("token").alias("_a"))
    owner = organizations.join(usable, organizations["owner_id"] == usable["_u"]).select("organization_id", F.col("token").alias("_o"))
    j = repos.join(adder, "added_by", "left").join(owner, "organization_id", "left")
    return j.select("repo_id", F.coalesce("_a", "_o").alias("token"), F.when(F.col("_a").isNotNull(), "added_by").when(F.col("_o").isNotNull(), "owner").alias("source"))


def unique_slugs(wanted: DataFrame, existing: DataFrame, slug: str = "slug", order: str | None = None) -> DataFrame:
    """(…, slug, unique): the slug, or with the first free number from 2 on, so that no two rows get the same.

    Rows that ask for one slug take it and then the free numbers in turn, by ``order`` (else by all their columns). Taken are
    slugs in ``existing``; the families of different slugs do not see each other's new numbers.
    """
    taken = existing.select(F.col(slug).alias("_taken")).distinct()
    tail = F.regexp_extract("_taken", r"^(.*)-(\d+)$", 2)
    family = taken.where(tail.rlike("^[1-9][0-9]{0,8}$")).select(F.regexp_extract("_taken", r"^(.*)-(\d+)$", 1).alias("_base"), tail.cast("int").alias("_n")).where("_n >= 2")
    # of each taken number, how many free ones stand before it
    before = F.transform(F.sort_array(F.collect_set("_n")), lambda n, i: n - 2 - i)
    gaps = family.groupBy("_base").agg(before.alias("_before"))
    turn = F.row_number().over(Window.partitionBy(slug).orderBy(order or F.struct(*wanted.columns)))
    j = wanted.withColumn("_turn", turn).join(taken, F.col(slug) == F.col("_taken"), "left").join(gaps, F.col(slug) == F.col("_base"), "left")
    free = F.col("_turn") - F.when(F.col("_taken").isNull(), 1).otherwise(0)  # which free number; none where this is 0
    number = free + 1 + F.coalesce(F.size(F.filter("_before", lambda b: b < free)), F.lit(0))
    return j.withColumn("unique", F.when(free == 0, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), number.cast("string")))).drop("_turn", "_taken", "_base", "_before")


def chat_messages(messages: DataFrame) -> DataFrame:
    """Sender view of the messages: the assistant is the bot, everyone else keeps the role."""
    return messages.withColumn("sender", F.when(F.col("role") == "assistant", "bot").otherwise(F.col("role")))


class StaleWrite(RuntimeError):
    """Someone else wrote a version since the one that a write builds on."""


class VersionedTable:
    """A Parquet table whose versions are directories; a numbered pointer file per version says where it lies.

    Works on any file system Spark can reach. A version is never overwritten, so a plan may read the table it
    writes to. Pointers are created exclusively: of two writers one takes the number, the other the next, or,
    if it names the version it builds on, a ``StaleWrite``. A pointer that stays empty is that of a writer which died.
    """

    #: Seconds that a reader waits for a pointer to be filled.
    PATIENCE = 2.0

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_pointers")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers taken, latest first."""
        return sorted((int(s.getPath().getName()) for s in self._fs.listStatus(self._folder)), reverse=True) if self._fs.exists(self._folder) else []

    def _pointer(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, f"{number:012d}")

    def version(self) -> int:
        """The latest number taken, 0 for none."""
        return next(iter(self._numbers()), 0)

    def _place(self, number: int) -> str | None:
        until = time.monotonic() + self.PATIENCE
        while not self._fs.getFileStatus(self._pointer(number)).getLen():
            if time.monotonic() > until:
                return None
            time.sleep(0.1)
        return self.spark.read.text(self._pointer(number).toString()).first()[0]

    def read(self) -> DataFrame | None:
        """The latest version that was written whole."""
        places = (self._place(n) for n in self._numbers())
        place = next((p for p in places if p), None)
        return self.spark.read.parquet(f"{self.path}/{place}") if place else None

    def write(self, df: DataFrame, *partition_by: str, after: int | None = None) -> int:
        """Write ``df`` as the next version and give its number. ``after`` is the version that ``df`` was made from."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        self._fs.mkdirs(self._folder)
        number = (self.version() if after is None else after) + 1
        while not self._take(number, name):
            if after is not None:
                raise StaleWrite(f"version {number} of {self.path} exists")
            number += 1
        return number

    def _take(self, number: int, name: str) -> bool:
        try:
            out = self._fs.create(self._pointer(number), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(name.encode()))
        out.close()
        return True
