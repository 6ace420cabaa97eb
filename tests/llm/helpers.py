import random

SF = "/root/testdata/sf0.001"
CLASH = ["key", "text2", "score", "predicted", "n_lines", "n_dropped", "shard", "slot", "node", "row", "bucket", "block", "h", "t", "d", "l", "bad", "keys", "kept",
         "__row", "__node", "__packed", "__bands", "__own", "__weight", "__origin", "__hashed", "__hash", "__bucket", "__place", "__start", "__every", "__all", "__at", "__text", "__best", "__score", "__good"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def docs(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source), with further columns whose names clash with those inside operators."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, *(["x"] * len(CLASH))) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def hard(spark):
    """Nulls, empty and very long texts, blanks only, repeated rows, ties."""
    long = " ".join(words(40_000, 1))
    return docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, long), (None, "a b c d e f"), (5, "one"), (6, "one two three"), (7, "x " * 300), (8, long), (8, long), (9, "ß É 日本 🙂\nline\n\nline"), (None, None)])


def empty(spark):
    return docs(spark, [(1, "a")]).limit(0)


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
