"""Registered queries of the subpackage against their SQL in DuckDB."""

import pytest

from qaframe.llm.queries import QUERIES
from qaframe.llm.sql import SQL
from tools.check_oracle import duck, norm_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert norm_rows(df.columns, rows) == norm_rows(cols, cur.fetchall())


def rule_rows():
    """Texts that each reach a rule, or just miss it."""
    good = "A plain sentence of the text that nobody would want to remove from it, with a full stop at its end."
    pad = "\n".join(f"{good[:-1]} and number {i} of them." for i in range(8))
    lines = ["We use cookies " + "and tell you about it at great length " * 15 + "in this notice.",     # over 300 characters
             "an unpunctuated line that goes on for more than forty characters",
             "averyveryverylongwordwithoutanyspaceandmarkatitsend another", "short one", "short one.",
             "tabs\tpart\tthese\twords without a mark", "tabs\tpart.", "\tPrivacy Policy of ours\t",
             "HOME", " Zurück ", "Lire la suite", "Iniciar sesión", "ALL OF THIS LINE IS SHOUTING AT YOU.",
             "ÜBER ALLES ÄRGERN SICH DIE LEUTE.", "one | two | three | four", "one | two and many more words that follow it here.",
             "### *** $$$", "a # in the middle of a long line is no reason to remove it.", "Alle Rechte vorbehalten.",
             "Tous droits réservés par la société.", "Todos los derechos reservados.", "日本語のテキスト、句読点あり。", "日本語のみ",
             "", "   ", "\x0b\x0c", "ends in a quote \u00bb", "two words\u2026", "it is \u2018so\u2019"]
    rows = [(i, pad + "\n" + x) for i, x in enumerate(lines)]
    rows += [(100 + i, "\n".join([x] * 3 + [good] * 2)) for i, x in enumerate(lines)]
    return rows + [(500, None), (501, ""), (502, "\n".join(lines)), (None, pad), (503, pad), (503, pad)]


def test_quality_rules_match_sql(spark, make_docs, tmp_path):
    """The rules of op1 and its SQL on rows that tell rules apart."""
    import duckdb
    path = str(tmp_path)
    make_docs(rule_rows()).coalesce(1).write.parquet(f"{path}/documents.parquet")
    df = QUERIES["op1_quality_rules"](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    cur = con.execute(SQL["op1_quality_rules"])
    cols = [d[0] for d in cur.description]
    ours = norm_rows(df.columns, [tuple(r) for r in df.collect()])
    assert ours == norm_rows(cols, cur.fetchall())
    failed = {r.doc_id: r.n_failed_lines for r in df.collect() if r.doc_id is not None and r.doc_id < 100}
    assert [failed[i] for i in range(9)] == [1, 0, 0, 1, 0, 0, 0, 1, 1]


def test_op2_query(spark):
    """Ids and texts of the registered query against the operator's model and the texts themselves."""
    import hashlib
    import zlib
    import public_tokenizers
    from qaframe.llm.pieces import UnigramModel, load_pieces
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = QUERIES["op2_sentencepiece"](spark, SF)
    assert df.columns == ["doc_id", "n_tokens", "n_bytes", "ids_crc32", "decoded_sha256"]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    model = UnigramModel(load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    ids = dict(zip(docs, model.encode(list(docs.values()))))
    for r in rows:
        assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]) // 4, zlib.crc32(ids[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].replace("\u2581", " ").encode()).hexdigest()
