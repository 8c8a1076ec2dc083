from tests.llm.cases import awkward, nothing  # noqa: F401
