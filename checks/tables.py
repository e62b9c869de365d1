"""The model tables, derived by Spark from the given parquet tables (whole tables, no subsets)."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import geometry
from labelmill.functions.labels import derive_status


def line_key():
    """Lines of one order, part, supplier and number differ in price."""
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return F.concat_ws("-", *parts, F.floor(F.col("l_extendedprice") * 100).cast("string"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- Text ------------------------------------------------------------

    @cached_property
    def comments(self) -> DataFrame:
        docs, labels = self.raw("documents"), self.raw("labels")
        joined = docs.join(labels, "doc_id", "left")
        labelled = F.col("quality").isNotNull()
        created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
        key = F.col("doc_id").cast("string")
        nobody = F.lit(None).cast("string")
        sentiment = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative")
        return joined.select(
            key.alias("comment_id"), F.col("source").alias("dataset_id"), key.alias("source_id"), "text",
            F.coalesce(sentiment, F.lit("unannotated")).alias("sentiment"), F.col("lang").alias("type"),
            F.when(labelled, "annotated").otherwise("pending").alias("status"),
            F.when(F.col("toxic") == 1, (F.col("doc_id") % 5).cast("string")).alias("assigned_to"),
            F.lit(None).cast("timestamp").alias("assigned_at"), nobody.alias("assigned_by"),
            F.when(labelled, (F.col("doc_id") % 7).cast("string")).alias("annotated_by"),
            F.when(labelled, F.timestamp_seconds(F.lit(1704069000) + F.col("doc_id") * 60)).alias("annotated_at"),
            nobody.alias("note"), F.lit(1).cast("bigint").alias("version"),
            F.lit("0").alias("created_by"), F.lit("0").alias("updated_by"),
            created.alias("created_at"), created.alias("updated_at"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("user_id"),
            "event_type", "value", F.get_json_object("props", "$.k").alias("k"),
        )

    @cached_property
    def versions(self) -> DataFrame:
        sentiment = F.when(F.col("event_type") == "purchase", "negative").when(
            F.col("event_type").isin("click", "signup"), "positive"
        ).otherwise("unannotated")
        type_ = F.when(F.col("value") >= 10, "en").otherwise("fr")
        none = F.lit(None).cast("string")
        return self.events.select(
            F.col("k").alias("comment_id"), F.col("event_id").alias("version"),
            F.struct(
                F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"),
                sentiment.alias("sentiment"), type_.alias("type"),
                derive_status(sentiment, type_).alias("status"), none.alias("assigned_to"),
                F.col("user_id").alias("annotated_by"), F.col("ts").alias("annotated_at"),
                F.when(F.col("event_type") == "signup", "signed").alias("note"),
            ).alias("snapshot"),
            F.array(F.lit("sentiment")).alias("changed_fields"), F.lit("annotation").alias("change_type"),
            F.lit(None).cast("bigint").alias("restored_from"), F.col("user_id").alias("changed_by"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def patches(self) -> DataFrame:
        sentiment = (
            F.when(F.col("event_type") == "click", "positive")
            .when(F.col("event_type") == "view", "neutral")
            .when(F.col("event_type") == "purchase", "negative")
            .when(F.col("event_type") == "error", "bogus")
        )
        signup = F.col("event_type") == "signup"
        return self.events.select(
            F.col("k").alias("comment_id"), F.col("event_id").alias("seq"), sentiment.alias("sentiment"),
            F.lit(None).cast("string").alias("type"),
            F.when(signup & (F.col("value") >= 10), F.concat(F.lit("note of "), "user_id")).alias("note"),
            signup.alias("has_note"), "user_id", F.col("ts").alias("at"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("action"),
            F.col("user_id").alias("actor_id"), F.lit("comment").alias("target_type"),
            F.col("k").alias("target_id"), F.col("ts").alias("at"),
        )

    @cached_property
    def datasets(self) -> DataFrame:
        n = F.substring("source", 4, 9).cast("int")
        per = self.raw("documents").groupBy("source").agg(
            F.count("*").alias("total_rows"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
        )
        status = F.element_at(
            F.array(F.lit("completed"), F.lit("processing"), F.lit("pending"), F.lit("failed")), n % 4 + 1
        )
        none = F.lit(None).cast("string")
        return per.select(
            F.col("source").alias("dataset_id"), F.concat(F.lit("Dataset "), "source").alias("name"),
            "total_rows", status.alias("status"), none.alias("import_error"),
            F.when(n % 2 == 0, F.concat(F.lit("tx"), n.cast("string"))).alias("taxonomy_id"),
            F.when(n % 2 == 0, F.concat(F.lit("Taxonomy "), n.cast("string"))).alias("taxonomy_name"),
            (n % 3).cast("string").alias("uploaded_by"), (n % 5).cast("string").alias("assigned_to"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("lo") * 60).alias("created_at"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("hi") * 60).alias("updated_at"),
        )

    @cached_property
    def taxonomies(self) -> DataFrame:
        """Vocabularies in use among the labelled documents of every other source."""
        n = F.substring("dataset_id", 4, 9).cast("int")
        used = self.comments.where((F.col("status") == "annotated") & (n % 2 == 0) & (n % 6 != 0))

        def terms(column: str):
            values = F.array_sort(F.collect_set(column))
            return F.transform(
                values,
                lambda v, i: F.struct(
                    v.alias("value"), F.upper(v).alias("label"), i.cast("double").alias("order")
                ),
            ).alias(column)

        grouped = used.groupBy("dataset_id").agg(terms("sentiment"), terms("type"))
        return grouped.select(
            F.concat(F.lit("tx"), n.cast("string")).alias("taxonomy_id"),
            F.concat(F.lit("Taxonomy "), n.cast("string")).alias("name"), "sentiment", "type",
            (n % 4 == 0).alias("is_active"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("name"),
            F.lower(F.concat("c_name", F.lit("@example.com"))).alias("email"),
            F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("annotator").alias("role"),
            (F.col("c_acctbal") > 0).alias("is_active"),
        )

    @cached_property
    def conversation_rows(self) -> DataFrame:
        """Raw import rows: one file per role, ids repeated within a conversation."""
        return self.raw("conversations").select(
            F.col("role").alias("file"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_no"),
            F.col("conv_id").cast("string").alias("id"), F.col("text").alias("comment_text"),
            F.when(F.col("turn") % 3 == 0, " Positive ").when(F.col("turn") % 3 == 1, "odd").alias("sentiment"),
            F.when(F.col("turn") % 2 == 0, "ENGLISH").alias("type"),
        )

    @cached_property
    def document_rows(self) -> DataFrame:
        """Raw import rows with clashing ids, taken ``-dupN`` names and empty cells; one file per source."""
        stem = F.concat("lang", F.lit("-"), (F.col("n_chars") % 4).cast("string"))
        taken = F.concat(stem, F.lit("-dup"), (F.col("doc_id") % 5 + 1).cast("string"))
        return self.raw("documents").select(
            F.col("source").alias("file"), F.col("doc_id").alias("row_no"),
            F.when(F.col("doc_id") % 13 == 0, "  ").when(F.col("doc_id") % 6 == 0, taken).otherwise(stem).alias("id"),
            F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(F.col("text")).alias("comment_text"),
            F.lit("positive").alias("sentiment"), F.col("lang").alias("type"),
        )

    # --- Media -----------------------------------------------------------

    @cached_property
    def assets(self) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        known = F.col("o_orderstatus") != "P"
        video = F.col("o_orderkey") % 10 == 0
        return self.raw("orders").select(
            key.alias("asset_id"), F.col("o_orderpriority").alias("dataset_id"),
            F.when(video, "video").otherwise("image").alias("kind"),
            F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("img_"), key, F.lit(".png"))).alias("file_name"),
            F.lit("png").alias("extension"), F.floor("o_totalprice").cast("bigint").alias("size_bytes"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("checksum"),
            F.when(known, 320 + F.col("o_custkey") % 1600).alias("width"),
            F.when(known, 240 + F.col("o_custkey") % 900).alias("height"),
            F.when(video, F.col("o_custkey") * 100).alias("duration_ms"),
            F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("annotation_count"),
            F.when(F.col("o_custkey") % 3 == 0, (F.col("o_custkey") % 5).cast("string")).alias("assigned_to"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    @staticmethod
    def _box_columns():
        video = F.col("l_orderkey") % 10 == 0
        return [
            line_key().alias("annotation_id"),
            F.col("l_orderkey").cast("string").alias("asset_id"),
            F.when(F.col("l_tax") == 0.08, "classification").otherwise("bbox").alias("kind"),
            F.col("l_returnflag").alias("label"),
            (F.col("l_discount") * 12 - 0.1).alias("x"), (F.col("l_tax") * 5).alias("y"),
            (F.col("l_quantity") / 50).alias("width"), (F.col("l_linenumber") / 7).alias("height"),
            F.when(video, F.col("l_linenumber").cast("bigint")).alias("frame_index"),
            F.when(video, F.col("l_linenumber") * F.lit(1000).cast("bigint")).alias("timestamp_ms"),
            F.col("l_suppkey").cast("string").alias("created_by"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
        ]

    @cached_property
    def raw_boxes(self) -> DataFrame:
        return self.raw("lineitem").select(*self._box_columns())

    @cached_property
    def annotations(self) -> DataFrame:
        made = geometry.normalize_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
        owner = self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("asset_id"), F.col("o_orderpriority").alias("dataset_id")
        )
        # The join moves the lines as they are; what is made of them is longer.
        lines = self.raw("lineitem").join(owner, F.col("l_orderkey").cast("string") == F.col("asset_id"))
        key, _, *facts = self._box_columns()
        boxes = lines.select(key, "asset_id", "dataset_id", *facts)
        boxes = boxes.withColumn("n", made).where(F.col("n.reason").isNull())
        is_box = F.col("kind") == "bbox"
        return boxes.select(
            "annotation_id", "asset_id", "dataset_id", "kind", "label",
            F.when(is_box, F.col("n.box.x")).alias("x"), F.when(is_box, F.col("n.box.y")).alias("y"),
            F.when(is_box, F.col("n.box.width")).alias("box_width"),
            F.when(is_box, F.col("n.box.height")).alias("box_height"),
            "frame_index", "timestamp_ms", "created_by", "created_at",
        )

    @cached_property
    def media_datasets(self) -> DataFrame:
        return self.raw("orders").groupBy(F.col("o_orderpriority").alias("dataset_id")).agg(
            F.min("o_orderdate").cast("timestamp").alias("created_at")
        ).select(
            "dataset_id", F.concat(F.lit("Media "), "dataset_id").alias("name"),
            F.when(F.col("dataset_id") != "4-NOT SPECIFIED", "flags").alias("label_set_id"), "created_at",
        )

    def label_set(self, set_id: str, values: list[str]) -> DataFrame:
        """One label set holding the given flags, in this order."""
        entries = [(v, f"Flag {v}", "#000000") for v in values]
        return self.spark.createDataFrame(
            [(set_id, entries)],
            "label_set_id string, labels array<struct<value:string,label:string,color:string>>",
        )

    @cached_property
    def classes(self) -> DataFrame:
        from labelmill.operators.vocabulary import class_list

        return class_list(self.media_datasets, self.label_set("flags", ["R", "A", "Z"]))

    @cached_property
    def class_items(self) -> DataFrame:
        """Label-set items: one set per part brand and size."""
        part = self.raw("part")
        return part.select(
            F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("label_set_id"),
            F.col("p_partkey").alias("idx"), F.initcap("p_name").alias("label"),
            F.lit(None).cast("string").alias("value"),
            F.when(F.col("p_type") == "ECONOMY", "#00ff00").alias("color"),
        )

    @cached_property
    def term_items(self) -> DataFrame:
        """Taxonomy items: one taxonomy per part brand; names are its sentiments, sizes its types."""
        part = self.raw("part")
        names = part.select(
            F.col("p_brand").alias("taxonomy_id"), F.lit("sentiment").alias("axis"),
            F.col("p_name").alias("label"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("idx"),
        )
        names = names.groupBy("taxonomy_id", "axis", "label").agg(
            F.min("idx").alias("idx"), F.max("price").alias("order")
        )
        sizes = part.groupBy(
            F.col("p_brand").alias("taxonomy_id"), F.lit("type").alias("axis"),
            F.concat(F.lit(" Size #"), F.col("p_size").cast("string")).alias("label"),
        ).agg(F.min("p_partkey").alias("idx"), F.lit(None).cast("double").alias("order"))
        return names.unionByName(sizes).withColumn("value", F.lit(None).cast("string"))

    # --- Presence --------------------------------------------------------

    @cached_property
    def heartbeats(self) -> DataFrame:
        state = F.when(F.col("event_type").isin("click", "purchase"), "active").when(
            F.col("event_type") == "view", "idle"
        ).otherwise("away")
        return self.events.select(
            "user_id",
            F.concat(F.lit("session-"), (F.col("user_id").cast("bigint") % 3).cast("string")).alias("session_key"),
            state.alias("state"), "ts",
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("action"),
            F.lit("comment").alias("target_type"), F.col("k").alias("target_id"),
        )
