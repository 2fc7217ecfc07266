"""Registered queries: conversation buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import conversation
from lectern.plans.registered.registry import register, table


@register("conversation_buffer", """
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4
""")
def conversation_buffer(spark, sf_dir):
    return conversation.buffered(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@register("conversation_history", """
WITH kept AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id, '## Historial de la conversa' || chr(10) || string_agg(
    CASE WHEN role = 'user' THEN 'Usuari' ELSE 'Assistent' END || ': ' || CASE WHEN len(text) > 300 THEN left(text, 300) || '...' ELSE text END,
    chr(10) ORDER BY turn) AS history
FROM kept GROUP BY conv_id
""")
def conversation_history(spark, sf_dir):
    return conversation.history_text(table(spark, sf_dir, "conversations"), 2, 300)


@register("conversation_turns", "SELECT conv_id, count(*) // 2 AS turns FROM conversations GROUP BY conv_id")
def conversation_turns(spark, sf_dir):
    return conversation.turn_counts(table(spark, sf_dir, "conversations"))


@register("conversation_buffer_turns", "SELECT conv_id, least(count(*), 4) // 2 AS turns FROM conversations GROUP BY conv_id")
def conversation_buffer_turns(spark, sf_dir):
    return conversation.turn_counts(table(spark, sf_dir, "conversations"), 2)


@register("message_lengths", """
SELECT role, count(*) AS n, count(*) FILTER (len(text) > 1500) AS n_cut, max(least(len(text), 1503)) AS longest FROM conversations GROUP BY role
""")
def message_lengths(spark, sf_dir):
    size = F.length("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(size > 1500).alias("n_cut"), F.max(F.least(size, F.lit(1503))).cast("long").alias("longest")
    )
