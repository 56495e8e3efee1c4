"""Tables, training texts and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that stand in where no training file is given.
DEMO_TEXTS = (
    "Hợp tác xã nông nghiệp đã phát triển kinh tế.",
    "Học sinh chăm chỉ học tập ở nhà trường.",
    "Chợ nổi họp từ sáng sớm, thuyền bè tấp nập trên sông.",
    "Bác sĩ khuyên người bệnh uống thuốc đúng giờ và nghỉ ngơi.",
)
#: Samples (task, context, query, reference_answer) that stand in where none are given, for every task.
DEMO_SAMPLES = (
    (
        "long_document_qa",
        "Hợp đồng thuê nhà được ký ngày 12/3/2023 giữa bà Lan và ông Minh. Thời hạn thuê là hai năm, tiền thuê mỗi tháng là 7 triệu đồng, trả trước ngày 5. Bên thuê phải giữ gìn nhà cửa sạch sẽ và báo ngay cho bên cho thuê khi có hư hỏng.",
        "Tiền thuê mỗi tháng là bao nhiêu?",
        "tiền thuê mỗi tháng là 7 triệu đồng",
    ),
    (
        "long_document_qa",
        "Thư viện tỉnh mở cửa từ 8 giờ đến 17 giờ các ngày trong tuần, trừ thứ hai. Bạn đọc được mượn năm cuốn sách trong hai tuần. Sách trả muộn bị phạt một nghìn đồng mỗi ngày cho mỗi cuốn.",
        "Bạn đọc được mượn mấy cuốn sách?",
        "năm cuốn sách trong hai tuần",
    ),
    (
        "multi_turn_conversation",
        "Khách: Tôi muốn đổi vé tàu đi Huế. Nhân viên: Chị muốn đổi sang ngày nào? Khách: Sáng thứ sáu, chuyến sớm nhất. Nhân viên: Chuyến 6 giờ còn chỗ, phí đổi vé là 20 nghìn đồng. Khách: Vâng, chị đổi giúp tôi.",
        "Tóm tắt cuộc trò chuyện.",
        "Khách đổi vé tàu đi Huế sang chuyến 6 giờ sáng thứ sáu",
    ),
    (
        "needle_in_haystack",
        "Mùa xuân hoa nở khắp vườn, chim hót líu lo. Mùa hạ nắng vàng rực rỡ, ve kêu râm ran. Mật mã của kho là 4172. Mùa thu lá rụng đầy sân, trời xanh trong vắt. Mùa đông gió lạnh, mọi người quây quần bên bếp lửa.",
        "Mật mã của kho là gì?",
        "Mật mã của kho là 4172",
    ),
    (
        "agent_tool_calling",
        "Công cụ thời_tiết nhận thành_phố và ngày. Công cụ đặt_xe nhận điểm_đi, điểm_đến và giờ. Người dùng nói: ngày mai tôi ra sân bay lúc 9 giờ, hãy đặt xe từ khách sạn.",
        "Gọi công cụ nào?",
        "đặt_xe khách sạn sân bay 9 giờ",
    ),
    (
        "cross_lingual",
        "The market opens at dawn. Chợ họp từ lúc bình minh. Farmers bring rice and fruit. Nông dân mang gạo và trái cây đến bán.",
        "Nông dân mang gì đến chợ?",
        "Nông dân mang gạo và trái cây",
    ),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_texts(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(text) of a JSON list of strings or of objects with a text; without a path the demo texts."""
    if path is None:
        return spark.createDataFrame([(t,) for t in DEMO_TEXTS], "text string")
    raw = spark.read.text(path, wholetext=True)
    item = F.explode(F.from_json("value", "array<string>")).alias("item")
    return raw.select(item).select(F.coalesce(F.get_json_object("item", "$.text"), F.col("item")).alias("text")).where("text is not null")


def samples(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Benchmark samples (task, context, query, reference_answer, context_length, metadata); their tasks group them."""
    kind = "task string, context string, query string, reference_answer string, context_length int, metadata map<string,string>"
    return spark.createDataFrame(rows, kind)


def demo_samples(spark: SparkSession) -> DataFrame:
    """(doc_id, task, context, query, reference_answer) of the built-in samples."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(DEMO_SAMPLES)], "doc_id long, task string, context string, query string, reference_answer string")


def triples(spark: SparkSession) -> DataFrame:
    """(context, query, reference) of the built-in samples."""
    return demo_samples(spark).select("context", "query", F.col("reference_answer").alias("reference"))


def add_samples(held: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of samples, those of the second last."""
    return held.unionByName(more)


def samples_by_task(held: DataFrame) -> DataFrame:
    """(task, num_samples), a last row with a null task counting all."""
    return held.rollup("task").agg(F.count("*").alias("num_samples"))


def write_cells(cells: DataFrame, path: str) -> None:
    """JSON files, a folder for each method, task and ratio."""
    cells.write.partitionBy("method", "task", "ratio").json(path)


def write_run(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """A Markdown table of a report's lines, in their order."""
    head = lines.sparkSession.createDataFrame([("| method | quality | efficiency | harmonised |",), ("|---|---|---|---|",)], "line string")
    order = F.monotonically_increasing_id()
    both = head.select(F.lit(0).alias("part"), order.alias("i"), "line").unionByName(lines.select(F.lit(1).alias("part"), order.alias("i"), "line"))
    both.orderBy("part", "i").select("line").coalesce(1).write.text(path)
