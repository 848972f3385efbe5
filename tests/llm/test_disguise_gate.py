import pytest

from findloom.llm import pii


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail anna [ at ] example.org now", "email", "anna [ at ] example.org"), ("mail anna ( at ) example.org now", "email", "anna ( at ) example.org"),
        ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"), ("card 4111 1111 1111 111 one end", "card", "4111 1111 1111 111 one"),
        ("call +49 30 1234 five 67 now", "phone", "+49 30 1234 five 67"),
    ],
)
def test_every_rewrite_is_tried(text, kind, span):
    for before in ("", "a dot, and an @ sign: "):
        assert (kind, span) in [(pii.KINDS[k], (before + text)[a:b]) for a, b, k in pii.find(before + text)[1]]


def test_rewrites_are_linear():
    for text in (" " * 300_000, "one " * 100_000, " [" * 100_000, " at" * 100_000, " dot" * 100_000, "one" + "-" * 300_000):
        pii.find(text)
