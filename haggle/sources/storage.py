"""Reading tables, and a store of versions that replaces a table as a whole."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric key by several tasks. The range is that of the key at the time; filters go to the database.

    Rows beyond the range by the time they are read, and rows without a key, are in the first or last part. Needs the database's driver on the class path.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = reader.option("query", f"SELECT min({key}) AS low_end, max({key}) AS high_end FROM {name}").load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if low is None:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts)).load()


def write_keyed(rows: DataFrame, path: str, key: str, bloom: tuple[str, ...] = (), group_rows: int = 1 << 16) -> None:
    """A table for lookups: sorted by a key over all files, in row groups of about so many rows, with Bloom filters on other columns that are looked up.

    A lookup by key then reads the one group whose range holds it, one by another column those whose filter may hold the value.
    """
    writer = rows.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.row.count.limit", group_rows)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", group_rows)
    writer.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see. Under a local master, where none is set, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="haggle-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Conflict(Exception):
    """Another writer has made the version first."""


class Manifests:
    """A row of JSON files, one for each version of a table, each under a name that only one writer can take."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, path: str) -> list[str]:
        system, place = self._files(path)
        return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []

    def _remove(self, path: str) -> None:
        system, place = self._files(path)
        system.delete(place, True)

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return sorted(int(name[1:-5]) for name in self._names(f"{self.path}/manifests") if name.startswith("v"))

    def latest(self) -> int:
        """The newest version, -1 if there is none."""
        return max(self.versions(), default=-1)

    def _load(self, version: int | None = None):
        """What the manifest of a version says, or the newest before it; None if there is none."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return None
        system, place = self._files(f"{self.path}/manifests/v{known[-1]:012}.json")
        stream = system.open(place)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _store(self, version: int, said, replace: bool = False) -> None:
        """Give a manifest its name; without replace the name must be free (Conflict)."""
        jvm = self.spark.sparkContext._jvm
        system, draft = self._files(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = system.create(draft)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        _, final = self._files(f"{self.path}/manifests/v{version:012}.json")
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, how)
        except Exception as e:
            system.delete(draft, True)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there") from None
            raise


class Versions(Manifests):
    """A Parquet table in buckets by a hash of its key, of which every change is a new version.

    A manifest for each version says where its buckets lie, how many rows each has and how the hash is cut up. A change writes the buckets that it touches to a folder of
    its own, then the manifest under a name that only one writer can take; so a writer that dies or comes second changes nothing, and whoever opens the path reads the newest manifest
    and lists nothing else. A bucket of more than most_rows is cut in two when it is next written, so a change costs the same
    however large the table has become. buckets is their number at first: a first load of much data should come with many.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 1, most_rows: int = 1 << 18):
        super().__init__(spark, path)
        self.schema, self.key, self.buckets, self.most_rows = schema, key, buckets, most_rows

    def manifest(self, version: int | None = None) -> dict[tuple[int, int], tuple[str | None, int]]:
        """(modulus, remainder) of each bucket, with its folder and number of rows, as of a version (the newest without one)."""
        said = self._load(version)
        return {(self.buckets, r): (None, 0) for r in range(self.buckets)} if said is None else {(m, r): (folder, n) for m, r, folder, n in said}

    def _commit(self, version: int, manifest: dict, replace: bool) -> None:
        self._store(version, [(m, r, folder, n) for (m, r), (folder, n) in sorted(manifest.items())], replace)

    def bucket(self, rows: DataFrame, manifest: dict, split: bool = False) -> DataFrame:
        """rows with the bucket that they fall in, as modulus_remainder; with split, full buckets are cut in two."""
        cut = [c for (m, r), (_, n) in manifest.items() for c in ([(2 * m, r), (2 * m, r + m)] if split and n > self.most_rows else [(m, r)])]
        most = max(m for m, _ in cut)
        names = self.spark.createDataFrame([(f, f"{m}_{r}") for m, r in cut for f in range(r, most, m)], "fine int, bucket string")
        return rows.withColumn("fine", F.pmod(F.xxhash64(self.key), F.lit(most)).cast("int")).join(F.broadcast(names), "fine").drop("fine")

    def touched(self, rows: DataFrame, version: int) -> set[tuple[int, int]]:
        """The buckets that rows fall in: as many at most as there are buckets."""
        return {tuple(map(int, r.bucket.split("_"))) for r in self.bucket(rows.select(self.key), self.manifest(version)).select("bucket").distinct().collect()}

    def read(self, version: int | None = None, only: set[tuple[int, int]] | None = None) -> DataFrame:
        """The table as of a version (the newest without one), or some of its buckets."""
        paths = [f"{self.path}/{folder}/bucket={m}_{r}" for (m, r), (folder, _) in sorted(self.manifest(version).items()) if folder and (only is None or (m, r) in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _written(self, version: int, rows: DataFrame, manifest: dict) -> tuple[str, dict]:
        """Write rows by bucket; the folder, and of each bucket written the number of rows."""
        folder = f"v{version}-{uuid.uuid4().hex}"
        self.bucket(rows.select(*self.schema.fieldNames()), manifest, split=True).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        counts = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.StringType())])).parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()
        return folder, {tuple(map(int, r.bucket.split("_"))): r["count"] for r in counts}

    @staticmethod
    def _changed(manifest: dict, folder: str, counts: dict, whole: bool) -> dict:
        """The manifest after buckets (or halves of buckets) have been replaced; of the whole table, or of those written."""
        out = {}
        for (m, r), old in manifest.items():
            halves = [(2 * m, r), (2 * m, r + m)]
            if any(h in counts for h in halves):
                out |= {h: (folder if h in counts else None, counts.get(h, 0)) for h in halves}
            elif (m, r) in counts:
                out[m, r] = (folder, counts[m, r])
            else:
                out[m, r] = (None, 0) if whole else old
        return out

    def write(self, version: int, rows: DataFrame) -> None:
        """Make a version by replacing the buckets that rows fall in by rows. A version that is written again is replaced: for one writer whose attempts are numbered."""
        manifest = self.manifest(version - 1)
        folder, counts = self._written(version, rows, manifest)
        self._commit(version, self._changed(manifest, folder, counts, whole=False), replace=True)

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Make the next version from the newest one by a change of the whole table; its number.

        If another writer has made that version meanwhile, what was written goes and the change is made anew from theirs. A key that is there twice is an error, and nothing is changed.
        """
        for _ in range(tries):
            base = self.latest()
            manifest = self.manifest(base)
            folder, counts = self._written(base + 1, change(self.read(base)), manifest)
            try:
                if counts and not self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").groupBy(self.key).count().where("count > 1").isEmpty():
                    raise ValueError(f"a {self.key} would be there twice")
                self._commit(base + 1, self._changed(manifest, folder, counts, whole=True), replace=False)
                return base + 1
            except Conflict:
                self._remove(f"{self.path}/{folder}")
            except ValueError:
                self._remove(f"{self.path}/{folder}")
                raise
        raise Conflict(f"other writers were first {tries} times")

    def tidy(self, keep: int = 2) -> None:
        """Remove versions but the newest `keep`, with the buckets that only they had. What writers that died have left is none of these (see sweep)."""
        known = self.versions()
        if len(known) <= keep:
            return
        stays = {(folder, b) for v in known[-keep:] for b, (folder, _) in self.manifest(v).items() if folder}
        for v in known[:-keep]:
            for (m, r), (folder, _) in self.manifest(v).items():
                if folder and all(f != folder for f, _ in stays):
                    self._remove(f"{self.path}/{folder}")
                elif folder and (folder, (m, r)) not in stays:
                    self._remove(f"{self.path}/{folder}/bucket={m}_{r}")
            self._remove(f"{self.path}/manifests/v{v:012}.json")

    def sweep(self) -> None:
        """Remove folders that no version refers to. No writer may be at work."""
        used = {folder for v in self.versions() for folder, _ in self.manifest(v).values()}
        for name in self._names(self.path):
            if re.match(r"v\d+-", name) and name not in used:
                self._remove(f"{self.path}/{name}")
