"""Recall and precision of the two trained scanners on forms that their training lines do not have."""

import pytest

from lexloom.llm import pii, secret_scan
from forms import NOT_PERSONAL, NOT_SECRETS, PERSONAL, SECRETS


def held(lines, plain, spans_of):
    """(share of values that a span covers whole, share of spans that touch a value, what was missed, what was wrong)."""
    missed, right, wrong = [], 0, []
    for line, value in lines:
        text, at = line.format(value), line.index("{}")
        spans = spans_of(text)
        if not any(s <= at and at + len(value) <= e for s, e in spans):
            missed.append((line, value, [text[s:e] for s, e in spans]))
        right += sum(s < at + len(value) and at < e for s, e in spans)
        wrong += [(text, text[s:e]) for s, e in spans if e <= at or at + len(value) <= s]
    wrong += [(text, text[s:e]) for text in plain for s, e in spans_of(text)]
    return 1 - len(missed) / len(lines), right / max(1, right + len(wrong)), missed, wrong


def secret_spans(text):
    return [(s, e) for s, _, e in secret_scan.all_spans(text, secret_scan.trained())[1]]


def personal_spans(text):
    return [(s, e) for _, s, e in pii.all_spans(text, pii.trained())[1]]


@pytest.mark.parametrize("lines, plain, spans_of", [(SECRETS, NOT_SECRETS, secret_spans), (PERSONAL, NOT_PERSONAL, personal_spans)], ids=["secrets", "personal"])
def test_recall_and_precision_on_held_out_forms(lines, plain, spans_of):
    assert len(lines) + len(plain) >= 60
    recall, precision, missed, wrong = held(lines, plain, spans_of)
    assert recall >= 0.9, missed
    assert precision >= 0.95, wrong


def test_field_spans_that_reach_past_a_base_span_stay():
    for text in ("signature=abcDEF0123456789abc0123456789xyz", "GOOGLE_API_KEY is AIzaSyA1234567890abcdefGHIJKLmnopqrstuv"):
        base, every = secret_scan.all_spans(text, secret_scan.trained())
        assert set(base) <= set(every) and any(e - s >= 30 for s, k, e in every if k == 3)
    assert [k for _, k, _ in secret_scan.all_spans("password=hunter2hunter2hunter2", secret_scan.trained())[1]] == [0]  # the same span is not there twice
