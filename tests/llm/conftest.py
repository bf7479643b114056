import pytest

pytest.importorskip("codestrata.llm.registry")
