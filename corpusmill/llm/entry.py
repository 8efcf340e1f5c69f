"""Queries and SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import bpe, chat, cover_tree, media, mixture, ngram_join, quality, simple8b, toxicity, warc


def queries():
    return {
        "op1_mixture": mixture.op1_mixture,
        "op2_warc": warc.op2_warc,
        "op3_bpe": bpe.op3_bpe,
        "bpe_round_trip": bpe.bpe_round_trip,
        "op4_cover_tree": cover_tree.op4_cover_tree,
        "op5_media": media.op5_media,
        "op6_chat": chat.op6_chat,
        "op7_simple8b": simple8b.op7_simple8b,
        "simple8b_round_trip": simple8b.simple8b_round_trip,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql():
    return {"op2_warc": warc.SQL, "bpe_round_trip": bpe.ROUND_TRIP_SQL, "op4_cover_tree": cover_tree.SQL, "op5_media": media.SQL, "op9_ngram_join": ngram_join.SQL, "simple8b_round_trip": simple8b.ROUND_TRIP_SQL}
