"""COCO and YOLO files."""

import posixpath
import sys
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from labelmill.operators.numbering import number_rows
from labelmill.plans.exports import Coco, Yolo
from labelmill.sources.listing import located

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def coco_lines(coco: Coco, datasets: DataFrame, date_created: str = "") -> DataFrame:
    """``dataset_id, section, seq, value``: in this order the values join to one JSON document per dataset."""

    def elements(rows: DataFrame, section: int, columns: list[str], first: int) -> DataFrame:
        comma = F.when(F.col("_seq") == first, F.lit("")).otherwise(F.lit(","))
        return rows.select(
            "dataset_id", F.lit(section).alias("section"), F.col("_seq").cast("bigint").alias("seq"),
            F.concat(comma, F.to_json(F.struct(*columns))).alias("value"),
        )

    def frame(section: int, text) -> DataFrame:
        return datasets.select(
            "dataset_id", F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("seq"),
            text.alias("value"),
        )

    info = F.to_json(
        F.struct(
            F.col("name").alias("description"), F.lit("1.0").alias("version"),
            F.lit(date_created).alias("date_created"),
        )
    )
    images = number_rows(coco.images, ["dataset_id"], ["created_at", "id"], "_seq")
    skipped = number_rows(coco.skipped, ["dataset_id"], ["asset_id", "reason"], "_seq")
    parts = [
        frame(0, F.concat(F.lit('{"info":'), info, F.lit(',"licenses":[],"images":['))),
        elements(images, 1, ["id", "file_name", "width", "height", "frame_index"], 1),
        frame(2, F.lit('],"annotations":[')),
        elements(
            coco.annotations.withColumn("_seq", F.col("id")), 3,
            ["id", "image_id", "category_id", "bbox", "area", "iscrowd", "frame_index", "timestamp_ms"], 1,
        ),
        frame(4, F.lit('],"categories":[')),
        elements(coco.categories.withColumn("_seq", F.col("id")), 5, ["id", "name", "supercategory"], 0),
        frame(6, F.lit('],"skipped":[')),
        elements(skipped, 7, ["asset_id", "reason"], 1),
        frame(8, F.lit("]}")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_coco(coco: Coco, datasets: DataFrame, path: str, date_created: str = "") -> None:
    """One directory per dataset whose parts, in name order, join to one JSON document."""
    lines = coco_lines(coco, datasets, date_created)
    ordered = lines.repartitionByRange("dataset_id", "section", "seq").sortWithinPartitions(
        "dataset_id", "section", "seq"
    )
    ordered.select("dataset_id", "value").write.partitionBy("dataset_id").text(path)


def yolo_files(yolo: Yolo, root: str = "../") -> DataFrame:
    """``dataset_id, file, place, line`` of every file of the export."""
    labels = yolo.lines.select(
        "dataset_id", "file", F.struct("created_at", "annotation_id").alias("place"), "line"
    )

    def at(number):
        return F.struct(
            F.lit(None).cast("timestamp").alias("created_at"),
            F.format_string("%09d", number).alias("annotation_id"),
        ).alias("place")

    names = yolo.classes.select(
        "dataset_id", F.lit("classes.txt").alias("file"), at(F.col("class_id")), F.col("value").alias("line")
    )
    head = yolo.classes.groupBy("dataset_id").agg(F.count("*").alias("n")).select(
        "dataset_id",
        F.posexplode(
            F.array(
                F.lit("# YOLO dataset descriptor"), F.lit(f"path: {root}"), F.lit("train: images/train"),
                F.lit("val: images/val"), F.lit("test: images/test"),
                F.concat(F.lit("nc: "), F.col("n").cast("string")), F.lit("names:"),
            )
        ).alias("pos", "line"),
    )
    head = head.select("dataset_id", F.lit("data.yaml").alias("file"), at(F.col("pos")), "line")
    entry = F.concat(F.lit("  "), F.col("class_id").cast("string"), F.lit(": "), F.col("name"))
    listed = yolo.classes.select(
        "dataset_id", F.lit("data.yaml").alias("file"), at(F.col("class_id") + 100), entry.alias("line")
    )
    return labels.unionByName(names).unionByName(head).unionByName(listed)


@dataclass
class _Written(WriterCommitMessage):
    """A task attempt's folder and the files in it."""

    attempt: str
    files: list[str]


class _Loose:
    """A file for each name."""

    def __init__(self, system, base: str):
        self.system, self.base, self.names, self.out = system, base, [], None

    def begin(self, folder: str, file: str):
        """A stream to the next file."""
        self.close()
        name = f"{folder}/{file}"
        self.names.append(name)
        self.system.create_dir(posixpath.dirname(f"{self.base}/{name}"), recursive=True)
        self.out = self.system.open_output_stream(f"{self.base}/{name}")
        return self.out

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Archived:
    """Files as members of zip archives in their folder, up to ``members`` in each; ``names`` are the archives'."""

    def __init__(self, system, base: str, members: int):
        self.archives, self.prefix, self.members = _Loose(system, base), posixpath.basename(base), members
        self.folder, self.archive, self.out, self.held = None, None, None, 0

    @property
    def names(self) -> list[str]:
        return self.archives.names

    def begin(self, folder: str, file: str):
        if self.out is not None:
            self.out.close()
        if self.archive is None or folder != self.folder or self.held >= self.members:
            self.close()
            stream = self.archives.begin(folder, f"{self.prefix}-{len(self.names):05d}.zip")
            self.folder, self.archive, self.held = folder, zipfile.ZipFile(stream, "w"), 0
        self.held += 1
        # The size of a streamed file is not known when it begins.
        self.out = self.archive.open(zipfile.ZipInfo(file), "w", force_zip64=True)
        return self.out

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        if self.archive is not None:
            self.archive.close()
        self.archives.close()
        self.archive = self.out = None


class _TextFilesWriter(DataSourceWriter):
    """Rows (folder, file, line), sorted by file, to one text file for each folder and file, or to archives of
    ``members`` such files.

    A task attempt writes to a folder of its own under one hidden folder of the job. Files get their names when
    the whole job has succeeded, from the attempts that Spark counts; the hidden folder goes then, or when the
    job fails, with all that failed and speculative attempts have left.
    """

    def __init__(self, path: str, members: int = 0):
        self.path, self.members = path.rstrip("/"), members
        self.job = f"{self.path}/.writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        attempt = f"{self.job}/{uuid.uuid4().hex}"
        system, base = located(attempt)
        system.create_dir(base, recursive=True)
        files = _Archived(system, base, self.members) if self.members else _Loose(system, base)
        at, out = None, None
        try:
            for folder, file, line in iterator:
                if (folder, file) != at:
                    at, out = (folder, file), files.begin(f"{folder}", f"{file}")
                out.write(line.encode() + b"\n")
        finally:
            files.close()
        return _Written(attempt, files.names)

    def commit(self, messages) -> None:
        system, target = located(self.path)
        moves = [(f"{located(m.attempt)[1]}/{n}", f"{target}/{n}") for m in messages if m is not None for n in m.files]
        for folder in {posixpath.dirname(new) for _, new in moves}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: system.move(*move), moves))
        self.abort(messages)

    def abort(self, messages) -> None:
        system, hidden = located(self.job)
        if system.get_file_info(hidden).type.name != "NotFound":
            system.delete_dir(hidden)


class TextFiles(DataSource):
    """``df.write.format("text_files")``: a text file of any length for each folder and file named in the rows.

    With the option ``members`` they are members of zip archives of up to so many files.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "folder string, file string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TextFilesWriter(self.options["path"], int(self.options.get("members", "0")))


def write_yolo(yolo: Yolo, path: str, root: str = "../", members: int = 0) -> None:
    """``<path>/<dataset_id>/{classes.txt,data.yaml,labels/*.txt}``.

    Each task streams its files line by line from sorted rows, so a file of any length takes no more memory; files
    appear when all are written.

    A loose file takes a disk block whatever its length, and one of the driver's moves. With ``members`` the same files
    are members of ``<path>/<dataset_id>/*.zip``, so many in each at most: unpacked in place they are the loose export,
    and ``sources.archives.read_archives`` reads them as they are.
    """
    files = yolo_files(yolo, root)
    files.sparkSession.dataSource.register(TextFiles)
    keys = ["dataset_id", "file"]
    ordered = files.repartition(*keys).sortWithinPartitions(*keys, "place")
    rows = ordered.select(F.col("dataset_id").alias("folder"), "file", "line")
    rows.write.format("text_files").option("members", members).mode("append").save(path)
