"""Tables with the odd cases that every operator must take."""

LONG = "word passage mitten ladder " * 12_000
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, toxicity double, more string, list int"
ODD = [
    (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \t\n ", None, "a", 3), (4, LONG, "en", "a", len(LONG)), (5, "same text twice over here", "en", "a", 25), (5, "same text twice over here", "en", "a", 25),
    (6, "same text twice over here", "en", None, 25), (7, "Ünïcode ▁ wörds 😀 and \u200b more\x0bhere", "de", "b", 30), (None, "a row without an id of its own", None, "a", 30), (8, "one", "fr", "c", 3),
]


def documents(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, 0.5, "x", 3) for r in rows], DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def agrees(spark, duck, name, folder):
    """The registered query's rows equal those of its SQL on the tables of folder."""
    import os

    import __spark_entry__ as entry

    for file in os.listdir(folder):
        duck.execute(f"create or replace view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    ours = entry.queries()[name](spark, folder)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(ours.columns) == sorted(columns)
    assert sorted((tuple(r) for r in ours.select(columns).collect()), key=str) == sorted(cursor.fetchall(), key=str)
