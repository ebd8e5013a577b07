"""Rules: the authoring surface, their logical form, and their execution as DataFrames."""

from codelattice.rules.api import (  # noqa: F401
    And, Not, Or, QueryType, all_of, any_of, attribute, calls, compose_rule, custom_check, dockerfile_rule, final_stage_has, flows, go_rule, gt, gte, instruction, instruction_after, instruction_before, lt, lte, missing, missing_instruction, none_of, propagates, python_rule, regex, rule, rules_of,
    service_has, service_missing, set_default_propagation, set_default_scope, stage, variable,
)
