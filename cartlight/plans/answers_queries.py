"""N, S: answer scoring, scorer registry, token counts."""

from pyspark.sql import functions as F

from cartlight.functions.text import word_count
from cartlight.operators import answers as N
from cartlight.plans.registry import query, view

# an answer is appended to each text; a third of the truths is wrong on purpose
view("v_solution", """
select conv_id, turn, role,
  case when turn % 5 = 0 then 'number' when turn % 5 = 1 then 'qa' when turn % 5 = 2 then 'line' when turn % 5 = 3 then 'boxed' else 'formula' end as source,
  concat(text, case when turn % 5 = 0 then concat(' #### 1,', lpad(cast(conv_id as string), 6, '0'), ' done')
    when turn % 5 = 1 then concat('<answer>no</answer><answer> The ', role, '! </answer>')
    when turn % 5 = 2 then concat(chr(10), 'Answer: ', chr(92), 'text{n} = $', cast(conv_id as string), '$ km', chr(10), 'end')
    when turn % 5 = 3 then concat(chr(92), 'boxed{x_{', cast(conv_id as string), '}}. ')
    else concat(chr(92), 'boxed{k = ', chr(92), 'dfrac1{', cast(conv_id + 10 as string), '}}') end) as solution,
  case when conv_id % 3 = 0 then 'wrong'
    when turn % 5 = 0 then concat('1', lpad(cast(conv_id as string), 6, '0'))
    when turn % 5 = 1 then upper(role) when turn % 5 = 2 then cast(conv_id as string)
    when turn % 5 = 3 then concat('x_{', cast(conv_id as string), '}')
    else concat(chr(92), 'frac{1}{', cast(conv_id + 10 as string), '}') end as truth
from conversations
""")

for name, fn in {
    "number": N.score_last_number,
    "qa": lambda s, g: N.score_qa_em(s, F.array(g)),
    "line": N.score_answer_line,
    "boxed": lambda s, g: N.score_boxed(s, g, tail=None),
    "formula": N.score_boxed_equiv,
}.items():
    N.register_scorer(name)(fn)

RIGHT = "select conv_id, turn, case when conv_id % 3 <> 0 then 1.0::double else {bad}::double end as score from v_solution where source = '{src}'"


def scored(t, source, fn):
    df = t.v_solution.filter(F.col("source") == source)
    return df.select("conv_id", "turn", fn(F.col("solution"), F.col("truth")).alias("score"))


@query("score_last_number", RIGHT.format(src="number", bad="0.0"))
def score_last_number(t):
    return scored(t, "number", N.score_last_number)


@query("last_number_flexible", """
select conv_id, turn, coalesce(list_filter(regexp_extract_all(concat(text, ' 12.5 and ', conv_id, ' . '), '-?[0-9.,]+'), lambda x: x not in ('', '.'))[-1], '-') as answer from conversations
""")
def last_number_flexible(t):
    text = F.concat("text", F.lit(" 12.5 and "), F.col("conv_id").cast("string"), F.lit(" . "))
    return t.conversations.select("conv_id", "turn", F.coalesce(N.last_number(text, strict=False), F.lit("-")).alias("answer"))


@query("score_qa_em", RIGHT.format(src="qa", bad="0.0"))
def score_qa_em(t):
    return scored(t, "qa", lambda s, g: N.score_qa_em(s, F.array(g)))


@query("score_qa_subem", "select conv_id, turn, case when conv_id % 3 <> 0 then 1.0::double else 0.1::double end as score from v_solution where source = 'qa'")
def score_qa_subem(t):
    return scored(t, "qa", lambda s, g: N.score_qa_subem(s, F.array(g), format_score=0.1))


# articles between characters that are no part of a word; twice, since neighbours share these
ARTICLES = "regexp_replace({0}, '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}_])(a|an|the)($|[^\\p{{L}}\\p{{M}}\\p{{Nd}}_])', '\\1 \\3', 'g')"
PLAIN = "regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g')"


@query("normalize_answer", "select conv_id, turn, md5(trim(regexp_replace(" + ARTICLES.format(ARTICLES.format(PLAIN)) + ", '\\s+', ' ', 'g'))) as digest from conversations")
def normalize_answer(t):
    return t.conversations.select("conv_id", "turn", F.md5(N.normalize_answer(F.col("text"))).alias("digest"))


@query("score_answer_line", RIGHT.format(src="line", bad="-1.0"))
def score_answer_line(t):
    return scored(t, "line", N.score_answer_line)


@query("score_boxed", RIGHT.format(src="boxed", bad="-1.0"))
def score_boxed(t):
    return scored(t, "boxed", lambda s, g: N.score_boxed(s, g, tail=None))


@query("score_boxed_equiv", RIGHT.format(src="formula", bad="0.0"))
def score_boxed_equiv(t):
    return scored(t, "formula", N.score_boxed_equiv)


@query("score_table", """
select source, count(*) as n, round(avg(case when conv_id % 3 <> 0 then 1.0 when source in ('line', 'boxed') then -1.0 else 0.0 end), 6) as mean_score from v_solution group by 1
""")
def score_table(t):
    out = N.score_table(t.v_solution)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("token_count", """
select doc_id, case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) end as tokens from documents
""")
def token_count(t):
    return t.documents.select("doc_id", word_count(F.col("text")).alias("tokens"))
