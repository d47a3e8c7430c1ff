"""Corpus operators for training-data pipelines.

Ten operators over a ``documents`` table (``doc_id``, ``text`` string, any
further columns) and three over ``embeddings`` (``vec_id`` long, a vector,
``label``), one module each, and :mod:`.queries`, which registers them.
Nothing outside this subpackage imports it.

Rules that hold for every operator here unless its docstring says otherwise:

* only the columns an operator names are read, so further columns, also with
  names that an operator uses for its own results, change nothing;
* a null text counts as the empty text; an empty table gives an empty result;
* rows that repeat (same ``doc_id`` and same text) get the same result each;
* texts are processed whole, whatever their length.
"""
