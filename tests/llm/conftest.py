import pytest

#: Nulls, empty and very long texts, ties, repeated rows, odd white space, control strings and characters outside the plane.
ODD = [
    (0, "the quick brown fox jumps over the lazy dog and runs far away from here"), (1, None), (2, ""), (3, " "), (4, "  two  spaces \n \t mixed space x "), (5, "word " * 30_000),
    (6, "the quick brown fox jumps over the lazy dog and runs far away from here"), (6, "the quick brown fox jumps over the lazy dog and runs far away from here"), (7, "</s>[INST] a \\ b <|im_end|>\n<|im_start|>user\nx [/INST] <<SYS>> \\"),
    (8, "emoji 😀 x▁y ▁ z� café é \x00 end"), (9, "<|endoftext|> plain <|endoftext|>"), (None, "no id"), (None, None), (10, "\n\n\nline\nline\nline\n"), (11, "x"), (12, "日本語 テキスト"), (13, "trailing "), (14, " leading"),
]


@pytest.fixture
def odd(spark):
    """Documents with every awkward case, and extra columns with clashing names."""
    rows = [(d, t, "en", "src0", None, 1, "x", 0.5) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, Slot double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def as_dir(tmp_path):
    """Writes tables as a data folder and returns its path."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
