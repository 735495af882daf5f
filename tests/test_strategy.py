"""Every code of the answer's validation, sentences with citations behind them, nulls."""

from corvex.functions import strategy

SCHEMA = (
    "answer_id string, pack_id string, response_pack_id string, requested_output string, answer string, allowed array<string>, claims array<struct<ids:array<string>>>, "
    "risks array<struct<ids:array<string>>>, counterarguments array<struct<counterargument:string,response:string,supporting_ids:array<string>,response_ids:array<string>>>, "
    "reasoning struct<ids:array<string>,checklist:array<string>,lawyer_verification:boolean>"
)
ITEMS = ["p_item_001", "p_item_002"]
FULL = (ITEMS, ["a paper"], True)


def found(spark, **changes):
    row = {"answer_id": "x", "pack_id": "p", "response_pack_id": "p", "requested_output": "strategy_report", "answer": "The tenant must pay p_item_001.", "allowed": ITEMS, "claims": [(["p_item_001"],)], "risks": [], "counterarguments": [], "reasoning": FULL} | changes
    rows = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.replace("struct<", "struct<").split(", ") if c.split()[0] in row)], SCHEMA)
    return sorted((r.code, r.path, *r.unknown) for r in strategy.issues(rows).collect())


def test_codes(spark):
    assert found(spark) == []
    assert found(spark, claims=[([],), (["p_item_009", "p_item_002"],)]) == [("claim_out_of_pack", "claims[1]", "p_item_009")]
    assert found(spark, answer="They shall pay q_item_003, p_item_001 and a_item_004.") == [("answer_out_of_pack", "answer", "a_item_004", "q_item_003")]
    assert found(spark, response_pack_id="other") == [("pack_id_mismatch", "pack_id")]
    assert found(spark, risks=[(["z_item_001"],)]) == [("risk_out_of_pack", "risks[0]", "z_item_001")]
    assert found(spark, counterarguments=[("none", "here", [], []), ("The court may differ", "", [], []), ("x", "y", ["p_item_001"], ["b_item_001"])]) == [("counterargument_out_of_pack", "counterarguments[2]", "b_item_001"), ("uncited_counterargument", "counterarguments[1]")]
    assert found(spark, reasoning=(["p_item_003"], [], False)) == [("lawyer_verification_required", "reasoning.lawyer_verification"), ("missing_evidence_checklist_required", "reasoning.checklist"), ("reasoning_pack_out_of_pack", "reasoning", "p_item_003")]
    assert found(spark, reasoning=None) == []
    assert found(spark, reasoning=None, requested_output="lawyer_review_pack") == [("missing_reasoning_pack", "reasoning")]
    assert found(spark, answer="It will WIN, p_item_001.") == [("unsafe_final_advice_wording", "answer")]


def test_sentences(spark):
    bad = lambda text: [p for c, p in found(spark, answer=text) if c == "uncited_legal_sentence"]
    assert bad("The act binds. Nothing here.  See section 5!") == ["answer[1]", "answer[3]"]
    # A sentence that only cites belongs to the one before it, and isn't counted.
    assert bad("The act binds. [p_item_001]. The court may act.") == ["answer[2]"]
    assert bad("[p_item_001] so. The act binds. p_item_001. p_item_002. It must be") == ["answer[3]"]
    assert bad("It must be p_item_001. It shall. p_item_002 shall.") == ["answer[2]"]
    assert bad("actual factor acting") == []
    assert found(spark, answer=None) == [] and found(spark, answer="") == []
    assert set(bad("It must. " * 20_000)) == {f"answer[{i}]" for i in range(1, 20_001)}


def test_nulls(spark):
    assert found(spark, claims=None, risks=None, counterarguments=None, allowed=None, answer="fine", reasoning=None) == []
    assert found(spark, claims=[(None,)], counterarguments=[(None, None, None, None)]) == []
    assert found(spark, pack_id=None, response_pack_id=None) == []
