"""What spares whole texts: words that a pattern needs, and cells made of a text at once."""

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import summary as M


def test_alternatives_of_a_pattern():
    assert M.alternatives(r"(?:through|thru|to)\s+(\d)") == [["through ", "thru ", "to "]]
    assert M.alternatives(r"(?:a|b)?x(?:cd|ef)(y(?:gh|ij))(?:&|and)\((?:kl|mn)\)") == [["cd", "ef"], ["kl", "mn"]]
    assert all(M.literal(p) or M.alternatives(p) for ps in M.PATTERNS.values() for p in ps)


def test_gated_fields(spark):
    text = "service\nfrom 1/2/2024 THRU\t2/1/2024"
    row = M.summary_text(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (row["invoice_st_dtm"], row["invoice_end_dtm"]) == ("1/2/2024", "2/1/2024")


def test_cells_of_a_text_at_once(spark):
    texts = ["", None, " a \t b \n\n  c  d  e\r\n \n f", "\n", " \n \n ", "a\t\n  \n\tb  ", "x  y\r\r\nz "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.array_join(F.transform(F.split(F.coalesce("t", F.lit("")), "\n"), S.tsv_field), "\n")
    assert all(r[0] == r[1] for r in rows.select(each, S.tsv_lines("t")).collect())
