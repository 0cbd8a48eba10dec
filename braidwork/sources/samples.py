"""Built-in documents and questions, for a first run without any input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = (
    ("rivers", "Rivers and mills", "The Aldern rises in the Grey Hills and joins the Marne at Weston.\nIn 1794 Clara Holm built a paper mill at Weston. The mill was run by the Holm Company until 1931 and is a museum today."),
    ("signals", "Signals", "The semaphore line of Weston was designed by Edmund Pell for the Harbour Office. Pell had studied optics in Lund. The line linked Weston with the port of Sall and was replaced by the telegraph in 1852."),
    ("harbour", "The harbour", "The Harbour Office of Sall keeps the tide tables of the coast. Its first director, Maria Lund, introduced the tide gauge of Anders Pell, a son of Edmund Pell. The gauge is shown at the mill museum of Weston."),
)
QUESTIONS = ("Who built the mill at Weston?", "How are Edmund Pell and the Harbour Office linked?", "What can be seen at the museum?")


def documents(spark: SparkSession) -> DataFrame:
    """id, title, content, ord."""
    return spark.createDataFrame([(*d, i) for i, d in enumerate(DOCUMENTS)], "id string, title string, content string, ord long")
