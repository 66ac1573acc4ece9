"""op9: main text of all pages."""

from pyspark.sql import functions as F

from careline.llm.common import read
from careline.llm.extract import with_main_text


def op9_html_extract(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages, keep=["page_id", "url"]).withColumn(
        "n_chars", F.length("text").cast("bigint"))


QUERIES = {"op9_html_extract": op9_html_extract}
ORACLE: dict[str, str] = {}
