import pytest

pytest.importorskip("spanrank.llm")
