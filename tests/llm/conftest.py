"""Fixtures of the training-data operators' tests."""

import pytest

pytest.importorskip("seawake.llm")
