"""Declared schemas of the sources; dotted paths of the raw frame."""

from __future__ import annotations

from pyspark.sql import types as T


def _nested(tree: dict) -> T.StructType:
    """A dict as a struct; a list holds the element of an array; a string is a type's name."""

    def kind(x) -> T.DataType:
        if isinstance(x, dict):
            return _nested(x)
        if isinstance(x, list):
            return T.ArrayType(kind(x[0]))
        return {"string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "long": T.LongType()}[x]

    return T.StructType([T.StructField(k, kind(v)) for k, v in tree.items()])


S = "string"

# The fields of the public registers' records, by the names that they have there.
#: A record of either register, as the document store holds it.
TRIAL_DOCUMENT = _nested(
    {
        "_id": S,
        "ctrname": S,
        "a2_eudract_number": S,
        "a1_member_state_concerned": S,
        "a3_full_title_of_the_trial": S,
        "a7_trial_is_part_of_a_paediatric_investigation_plan": S,
        "a8_ema_decision_number_of_paediatric_investigation_plan": S,
        "dimp": [{"d31_product_name": S, "d38_imp_identification_details": [{"d38_inn__proposed_inn": S}], "d391_inn_generic_name": S, "d25_the_imp_has_been_designated_in_this_indication_as_an_orphan_drug_in_the_community": S}],
        "e12_meddra_classification": [{"e12_term": S, "e12_system_organ_class": S}],
        "e71_human_pharmacology_phase_i": S,
        "e72_therapeutic_exploratory_phase_ii": S,
        "e73_therapeutic_confirmatory_phase_iii": S,
        "e74_therapeutic_use_phase_iv": S,
        "f11_trial_has_subjects_under_18": S,
        "f12_adults_1864_years": S,
        "f13_elderly_65_years": S,
        "f422_in_the_whole_clinical_trial": S,
        "x5_trial_status": S,
        "p_end_of_trial_status": S,
        "x6_date_on_which_this_record_was_first_entered_in_the_eudract_database": S,
        "n_date_of_competent_authority_decision": S,
        "p_date_of_the_global_end_of_the_trial": S,
        "trialInformation": {"recruitmentStartDate": S, "globalEndOfTrialDate": S},
        "b1_sponsor": [{"b11_name_of_sponsor": S, "b31_and_b32_status_of_the_sponsor": S}],
        "endPoints": {"endPoint": [{"readyForValues": S}]},
        "authorizedApplication": {
            "applicationInfo": [{"ctNumber": S, "trialStatus": S, "submissionDate": S, "decisionDate": S}],
            "eudraCt": {"eudraCtCode": S},
            "memberStatesConcerned": [{"mscName": S, "firstDecisionDate": S, "lastDecisionDate": S}],
            "authorizedPartI": {
                "products": [{"productName": S, "orphanDrugDesigNumber": S}],
                "sponsors": [{"organisation": {"name": S}, "commercial": S}],
                "rowSubjectCount": S,
                "trialDetails": {
                    "clinicalTrialIdentifiers": {"fullTitle": S, "publicTitle": S},
                    "scientificAdviceAndPip": {"paediatricInvestigationPlan": [{"pipNumber": S}]},
                    "trialInformation": {"medicalCondition": {"meddraConditionTerms": [{"termName": S, "organClass": S}]}, "trialDuration": {"estimatedRecruitmentStartDate": S, "estimatedEndDate": S}},
                },
            },
        },
        "authorizedPartI": {"trialDetails": {"trialInformation": {"trialDuration": {"estimatedRecruitmentStartDate": S}}}},
        "ctStatus": S,
        "trialPhase": S,
        "ageGroup": S,
        "resultsFirstReceived": S,
        "totalNumberEnrolled": S,
    }
)

_PART = "authorizedApplication.authorizedPartI"
_DETAILS = f"{_PART}.trialDetails"

# Paths in these records.
#: Column of the raw frame to its path in the document.
PATHS = {
    "a2": "a2_eudract_number",
    "products_e": "dimp.d31_product_name",
    "inn_1": "dimp.d38_imp_identification_details.d38_inn__proposed_inn",
    "inn_2": "dimp.d391_inn_generic_name",
    "under_18": "f11_trial_has_subjects_under_18",
    "adults": "f12_adults_1864_years",
    "elderly": "f13_elderly_65_years",
    "subjects_e": "f422_in_the_whole_clinical_trial",
    "terms_e": "e12_meddra_classification.e12_term",
    "organs_e": "e12_meddra_classification.e12_system_organ_class",
    "state_e": "a1_member_state_concerned",
    "title_e": "a3_full_title_of_the_trial",
    "pip_e": "a7_trial_is_part_of_a_paediatric_investigation_plan",
    "pip_number": "a8_ema_decision_number_of_paediatric_investigation_plan",
    "status_e": "x5_trial_status",
    "submitted_e": "x6_date_on_which_this_record_was_first_entered_in_the_eudract_database",
    "decided_e": "n_date_of_competent_authority_decision",
    "start_1": "trialInformation.recruitmentStartDate",
    "end_status": "p_end_of_trial_status",
    "end_1": "p_date_of_the_global_end_of_the_trial",
    "end_2": "trialInformation.globalEndOfTrialDate",
    "sponsor_e": "b1_sponsor.b11_name_of_sponsor",
    "sponsor_kind_e": "b1_sponsor.b31_and_b32_status_of_the_sponsor",
    "phase_1": "e71_human_pharmacology_phase_i",
    "phase_2": "e72_therapeutic_exploratory_phase_ii",
    "phase_3": "e73_therapeutic_confirmatory_phase_iii",
    "phase_4": "e74_therapeutic_use_phase_iv",
    "results_e": "endPoints.endPoint.readyForValues",
    "orphan_e": "dimp.d25_the_imp_has_been_designated_in_this_indication_as_an_orphan_drug_in_the_community",
    "ct": "authorizedApplication.applicationInfo.ctNumber",
    "transition": "authorizedApplication.eudraCt.eudraCtCode",
    "products_c": f"{_PART}.products.productName",
    "terms_c": f"{_DETAILS}.trialInformation.medicalCondition.meddraConditionTerms.termName",
    "organs_c": f"{_DETAILS}.trialInformation.medicalCondition.meddraConditionTerms.organClass",
    "states_c": "authorizedApplication.memberStatesConcerned",
    "title_c": f"{_DETAILS}.clinicalTrialIdentifiers.fullTitle",
    "public_title_c": f"{_DETAILS}.clinicalTrialIdentifiers.publicTitle",
    "pip_c": f"{_DETAILS}.scientificAdviceAndPip.paediatricInvestigationPlan",
    "status_c": "authorizedApplication.applicationInfo.trialStatus",
    "submitted_c": "authorizedApplication.applicationInfo.submissionDate",
    "start_2": f"{_DETAILS}.trialInformation.trialDuration.estimatedRecruitmentStartDate",
    "start_3": "authorizedPartI.trialDetails.trialInformation.trialDuration.estimatedRecruitmentStartDate",
    "end_3": f"{_DETAILS}.trialInformation.trialDuration.estimatedEndDate",
    "ct_status": "ctStatus",
    "sponsor_c": f"{_PART}.sponsors.organisation.name",
    "sponsor_kind_c": f"{_PART}.sponsors.commercial",
    "phase_c": "trialPhase",
    "decided_c": "authorizedApplication.applicationInfo.decisionDate",
    "results_c": "resultsFirstReceived",
    "orphan_c": f"{_PART}.products.orphanDrugDesigNumber",
    "ages_c": "ageGroup",
    "decided_first_c": "authorizedApplication.memberStatesConcerned.firstDecisionDate",
    "decided_last_c": "authorizedApplication.memberStatesConcerned.lastDecisionDate",
    "subjects_row_c": f"{_PART}.rowSubjectCount",
    "subjects_c": "totalNumberEnrolled",
}


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PIP_DECISION = T.StructType(
    _text("pip_procedure_number", "pip_decision_number", "ema_url", "decision_type_code", "decision_type_text", "decision_title", "decision_date", "active_substance", "therapeutic_area", "condition", "compliance_check_done").fields
    + [T.StructField(n, T.BooleanType()) for n in ("has_full_waiver", "has_partial_waiver", "has_deferral")]
    + _text("pdf_url", "parse_confidence", "fetched_at", "ema_feed_timestamp").fields
)
REGISTRY = T.StructType(_text("entity_id", "canonical", "legal_entity", "parent", "entity_type", "salt_form", "brand").fields + [T.StructField("confidence", T.DoubleType())] + _text("decided_by", "decided_at_utc", "model_id", "prompt_version", "merged_into", "note").fields)
ASSIGNMENTS = T.StructType(_text("raw", "entity_id").fields + [T.StructField("confidence", T.DoubleType())] + _text("channel", "reason", "decided_by", "decided_at_utc", "model_id", "prompt_version").fields)
VOCABULARY = _text("alias_clean", "substance_clean", "alias_type", "source")
SPONSOR_LABELS = _text("_id", "sponsor_clean", "sponsor_parent", "sponsor_type")
SUBSTANCE_LABELS = _text("_id", "substance_label")
LEDGER = _text("row_key", "action", "domain", "final_value", "decided_at_utc")
SPEND = T.StructType(_text("recorded_at_utc", "pass", "batch_id", "model_id").fields + [T.StructField(n, T.LongType()) for n in ("n_requests", "input_tokens", "output_tokens", "cache_read_tokens")] + [T.StructField("cost_usd", T.DoubleType())])
