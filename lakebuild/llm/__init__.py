"""Operators of a training-data pipeline, one module each.

==  =================  ==========================================================
 1  line_dedup         segment-partition edit join over lines (native)
 2  chat_format        budgeted, turn-aligned windows with loss masks (native)
 3  source_mix         token blocks drawn to target weights per output shard
 4  simhash_dedup      vantage-point partitioned SimHash near-duplicate groups
 5  maxent_lm          hashed maximum-entropy language model, train and score
 6  maxscore_topk      exact top-k inner products by MaxScore
 7  substring_dedup    windows found under a smaller id, joined into duplicate spans
 8  quality_rules      adaptive thresholds per language and source (native)
 9  vector_packing     dot-product vector bin packing of token pieces
10  html_extract       flat text blocks classified by a trained decision tree
11  k2treap_rank       ranked lexical search, K2-treap over the term-document grid
12  exact_dedup        exact copies by length, prefix hash, full hash (native)
13  rns_negatives      hard negatives by residue-number-system products
==  =================  ==========================================================

Nothing else in the library imports this subpackage. Functions that run in
Python workers are pickled by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
