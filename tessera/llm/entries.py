"""Queries and SQL of the training-data operators, as the entry module registers them."""

from __future__ import annotations

from tessera.llm.bytebpe import op12_trie_bpe
from tessera.llm.exact import op8_exact_dedup
from tessera.llm.negatives import op13_hard_negatives
from tessera.llm.ngram_join import op2_ngram_join
from tessera.llm.packing import op5_packing
from tessera.llm.pitman_yor import op1_pitman_yor
from tessera.llm.quality import STOP_WORDS, THRESHOLDS, op10_quality_rules
from tessera.llm.shard import BITS, SHARDS, hilbert_table, op6_hilbert_shards
from tessera.llm.substring import op3_substring_dedup
from tessera.llm.subword import op4_subword_dropout
from tessera.llm.toxicity import op7_toxicity
from tessera.llm.urlfilter import op9_url_filter
from tessera.llm.whitening import op11_whitening


def queries() -> dict:
    return {
        "op1_pitman_yor": op1_pitman_yor,
        "op2_ngram_join": op2_ngram_join,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_subword_dropout": op4_subword_dropout,
        "op5_packing": op5_packing,
        "op6_hilbert_shards": op6_hilbert_shards,
        "op7_toxicity": op7_toxicity,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_url_filter": op9_url_filter,
        "op10_quality_rules": op10_quality_rules,
        "op11_whitening": op11_whitening,
        "op12_trie_bpe": op12_trie_bpe,
        "op13_hard_negatives": op13_hard_negatives,
    }


WORDS = r"w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents)"

#: Every pair with a common five-word run, by way of the runs; classes by following links to the end.
OP2 = f"""WITH RECURSIVE {WORDS}, s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM w WHERE len(w) > 0)),
 z AS (SELECT doc_id, count(*) z FROM s GROUP BY 1), c AS (SELECT a.doc_id a, b.doc_id b, count(*) n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b, n = x.z AND n = y.z same FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE n >= 0.8 * (x.z + y.z - n)), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 k AS (SELECT a, min(b) m FROM r GROUP BY 1), q AS (SELECT a, count(*) links, count(*) FILTER (same) same FROM l GROUP BY 1)
 SELECT doc_id, least(doc_id, coalesce(m, doc_id)) class_id, coalesce(links, 0) n_links, coalesce(same, 0) + 1 n_copies FROM documents LEFT JOIN k ON k.a = doc_id LEFT JOIN q ON q.a = doc_id"""

OP3 = f"""WITH {WORDS}, v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM w WHERE len(w) >= 13)), f AS (SELECT g, min(doc_id) f FROM v GROUP BY 1),
 x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) p FROM v JOIN f USING (g) WHERE f < doc_id), t AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) p FROM w),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) kept FROM t ANTI JOIN x USING (doc_id, p) GROUP BY 1), n AS (SELECT doc_id, count(*) n FROM x GROUP BY 1)
 SELECT doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

OP8 = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t FROM documents), g AS (SELECT t, min(doc_id) keep_id, count(*) group_size FROM n GROUP BY 1)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(t) text_sha256 FROM n JOIN g USING (t)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8, byte by byte over the table of the polynomial."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        table.append(byte)
    codes = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(list_extract({table}::BIGINT[], (xor(a, b) & 255) + 1), a >> 8)), 4294967295)"


def op6_sql() -> str:
    """Cells, the curve's index by its automaton, plane after plane, and places in runs."""
    moves, digits = hilbert_table(3)
    steps, last = [], "c"
    for plane in reversed(range(BITS)):
        corner = f"(((l >> {plane}) & 1) + 2 * ((s >> {plane}) & 1) + 4 * ((z >> {plane}) & 1))"
        steps.append(f"k{plane} AS (SELECT * EXCLUDE (state, curve), list_extract({moves}, state * 8 + {corner} + 1) state, curve * 8 + list_extract({digits}, state * 8 + {corner} + 1) curve FROM {last})")
        last = f"k{plane}"
    cell = lambda name: f"""{name}_cell AS (SELECT v, 1 + (((dense_rank() OVER (ORDER BY v) - 1) * {(1 << BITS) - 1}) // n)::INT c FROM (SELECT DISTINCT {name} v, (SELECT count(DISTINCT {name}) FROM documents) n FROM documents WHERE {name} IS NOT NULL))"""
    return f"""WITH {cell("lang")}, {cell("source")}, d AS (SELECT doc_id, lang, source, coalesce(text, '') t FROM documents), e AS (SELECT *, strlen(t) + 8 size FROM d),
 c AS (SELECT doc_id, t, size, coalesce(a.c, 0) l, coalesce(b.c, 0) s, least({(1 << BITS) - 1}, floor(log2(size + 1)))::INT z, 0 state, 0::BIGINT curve FROM e LEFT JOIN lang_cell a ON a.v = lang LEFT JOIN source_cell b ON b.v = source),
 {", ".join(steps)}, x AS (SELECT doc_id, t, size, curve own_curve, first_value(curve) OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, curve) curve, {crc32_sql("t")} text_crc32 FROM {last}),
 r AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, sha256(t), own_curve, doc_id NULLS FIRST) - 1 r, count(*) OVER () // {SHARDS} f, count(*) OVER () % {SHARDS} g FROM x),
 y AS (SELECT *, CASE WHEN r < g * (f + 1) THEN r // (f + 1) ELSE g + (r - g * (f + 1)) // greatest(f, 1) END shard FROM r)
 SELECT doc_id, size, text_crc32, 'rows' law, shard::INT shard, r - shard * f - least(shard, g) slot, NULL::INT grown_shard, curve FROM y"""


def op10_sql() -> str:
    broken = []
    for rule, name, low, high, from_words in THRESHOLDS:
        out = " OR ".join([f"{name} < {low}"] * (low is not None) + [f"{name} > {high}"] * (high is not None))
        broken.append(f"CASE WHEN n_words >= {from_words} AND coalesce({out}, false) THEN '{rule}' END")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""WITH {WORDS}, b AS (SELECT doc_id, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls, len(w) n_words, length(array_to_string(w, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(regexp_extract_all(t, '[|]')) n_bars FROM w),
 v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM w WHERE len(w) >= 6)), d AS (SELECT doc_id, g FROM v GROUP BY 1, 2 HAVING count(*) > 1), r AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + 5)) p FROM v JOIN d USING (doc_id, g)) GROUP BY 1),
 m AS (SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(r.n, 0) n_repeat_words, len(ls) n_lines, n_bars,
  len(list_filter(w, lambda x: lower(translate(x, '.,;:!?', '')) IN ({stop}))) n_stop, len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) n_upper, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) n_stutter FROM b LEFT JOIN r USING (doc_id)),
 q AS (SELECT *, word_chars / nullif(n_words, 0) mean_word_length, n_symbols / nullif(n_words, 0) symbols_per_word, n_stop / nullif(n_words, 0) stop_ratio, n_dup_lines / nullif(n_lines, 0) dup_line_ratio, n_repeat_words / nullif(n_words, 0) repeat_word_ratio, n_upper / nullif(n_words, 0) upper_word_ratio, n_stutter / nullif(n_words, 0) stutter_ratio, n_bars / nullif(n_words, 0) bar_ratio FROM m),
 f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed, concat_ws(',', {', '.join(broken)}) failed_rules FROM q)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' kept, failed_rules FROM f"""


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; the others are tested against plain versions, round trips and held-out rows."""
    return {"op2_ngram_join": OP2, "op3_substring_dedup": OP3, "op6_hilbert_shards": op6_sql(), "op8_exact_dedup": OP8, "op10_quality_rules": op10_sql()}
