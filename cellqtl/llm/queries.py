"""Queries of the operators and, where SQL can express one, the SQL that gives the same rows."""

from .chat import SQL as CHAT_SQL
from .chat import op10_chat
from .html import op2_html
from .licenses import SQL as LICENSES_SQL
from .licenses import op8_licenses
from .media import op3_media
from .minhash import op4_minhash
from .mixing import SQL as MIXING_SQL
from .mixing import op7_mixing
from .packing import op5_packing
from .periodic import op13_periodic_runs
from .sharding import op6_sharding
from .topk import SQL as TOPK_SQL
from .topk import op9_topk
from .toxicity import op1_toxicity
from .trie import SQL as TRIE_SQL
from .trie import op12_prefix_trie
from .urls import SQL as URLS_SQL
from .urls import op11_urls

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_html, op3_media, op4_minhash, op5_packing, op6_sharding, op7_mixing, op8_licenses, op9_topk, op10_chat, op11_urls, op12_prefix_trie, op13_periodic_runs)}
SQL = {"op7_mixing": MIXING_SQL, "op8_licenses": LICENSES_SQL, "op9_topk": TOPK_SQL, "op10_chat": CHAT_SQL, "op11_urls": URLS_SQL, "op12_prefix_trie": TRIE_SQL}
