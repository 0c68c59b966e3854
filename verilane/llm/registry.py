"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audio, bpe, codes, html_text, kdtree, langid, merkle, packing, quality, sharding, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.query,
        "op2_langid": langid.query,
        "op3_sharding": sharding.query,
        "op4_toxicity": toxicity.query,
        "op5_html": html_text.query,
        "op6_topk": kdtree.query,
        "op7_packing": packing.query,
        "op8_bpe": bpe.query,
        "op9_audio": audio.query,
        "op10_quality": quality.query,
        "op11_merkle": merkle.query,
        "op12_warc": warc.query,
        "op13_codes": codes.query,
    }


def oracle_sql() -> dict:
    """Learned models, tokenizers, XXH64 with a seed, trees and media have no DuckDB form; tests hold these to brute force."""
    return {"op6_topk": kdtree.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL, "op13_codes": codes.ORACLE_SQL}
