import pytest

from corpuslab.llm import jaccard_join


@pytest.fixture(autouse=True)
def few_parts(request, monkeypatch):
    """Small tables are joined in one part, which saves many small jobs; tests named for parts keep the number."""
    if "parts" not in request.node.name:
        monkeypatch.setattr(jaccard_join, "KEY_PARTS", 1)
        monkeypatch.setattr(jaccard_join, "PAIR_PARTS", 1)
