"""Helpers of this folder's conftest under a name that tests can import."""

import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("_llm_conftest", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
frame, rows_of, hard_rows, LONG = _module.frame, _module.rows_of, _module.hard_rows, _module.LONG
