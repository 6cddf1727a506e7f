"""The whole mining run on any corpus, as one call.

    from wordmine import mine
    out = mine(corpus, lexicons)            # corpus: (doc_ix, text, shard, metadata)
    out["final_dedup"].write.parquet(...)

Returns every table the mining steps produce. The extraction table and the
audited rows are written once to the shared folder (``spark.checkpoint.dir``)
and read back, as each is read by several later steps; everything else is
lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..constants import MAX_DISP_LEN, TRIGGER_PHRASES
from ..operators import audit as AU
from ..operators import extract, frequency, search
from ..session import materialise
from .funnel import Lexicons, audit_rows, dedup_words, final_words


def mine(corpus: DataFrame, lexicons: Lexicons, phrases: list[str] = TRIGGER_PHRASES,
         arcs=None, max_disp_len: int = MAX_DISP_LEN,
         frequency_corpus: DataFrame | None = None) -> dict[str, DataFrame]:
    """Search, extract, filter, deduplicate and count coined words.

    ``arcs``: None (stage skipped), ``"pattern"`` or a token-arc table keyed by
    ``sent_id`` (see ``plans.funnel.with_sentence_id`` and ``operators.arcs``).
    ``frequency_corpus``: the corpus to count surface forms in (default: ``corpus``).
    """
    landed = search.landed_documents(corpus, phrases, max_disp_len)
    total = materialise(extract.spans_to_words(landed, partitioned=True), "extraction")
    audited = materialise(audit_rows(total, lexicons, phrases, arcs=arcs), "audited")
    final = final_words(audited)
    collected = frequency.collected_frequency(final)
    counted = frequency.corpus_frequency(collected, frequency_corpus or corpus)
    return {
        "landed": landed,
        "expression_counts": extract.expression_counts(landed, total),
        "total": total,
        "audited": audited,
        "stage_audit": AU.stage_audit(audited),
        "final": final,
        "final_dedup": dedup_words(final),
        "collected_frequency": collected,
        "corpus_frequency": frequency.sort_by_count(counted),
        "cardinality": frequency.cardinality_report(final, collected, counted),
    }
