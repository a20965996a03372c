"""From raw items to everything the cascade needs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quaestor.operators.corpus import build_corpus
from quaestor.operators.embed import HashingEncoder, attach, embed_distinct
from quaestor.operators.spelling import domain_terms, learn_vocabulary, merge_dictionary
from quaestor.plans.cascade import Knowledge


def build_knowledge(
    items: DataFrame,
    dictionary: DataFrame | None = None,
    encoder=None,
    max_faqs: int | None = None,
    learn_from: int | None = None,
    **options,
) -> Knowledge:
    """Corpus, vectors of its cleaned questions, and the words learned from its questions.

    `learn_from` limits learning to the first questions; by default all are used.
    """
    encoder = encoder or HashingEncoder()
    corpus = build_corpus(items, max_faqs)
    return prepare_knowledge(corpus, dictionary, encoder, learn_from, **options)


def prepare_knowledge(
    corpus: DataFrame,
    dictionary: DataFrame | None = None,
    encoder=None,
    learn_from: int | None = None,
    **options,
) -> Knowledge:
    """The same from a cleaned corpus. The result is lazy: write it to tables for reuse."""
    encoder = encoder or HashingEncoder()
    name = encoder.name
    vectors = embed_distinct(corpus, "question_clean", encoder, name)
    vocabulary = learn_vocabulary(corpus, "question", learn_from, ["faq_id"])
    accepted = domain_terms(vocabulary)
    if dictionary is not None:
        accepted = merge_dictionary(accepted, dictionary)
    return Knowledge(
        attach(corpus, vectors, "question_clean", name), accepted, vocabulary, encoder, **options
    )
