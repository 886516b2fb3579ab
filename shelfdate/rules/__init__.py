from .ruleset import BEFORE_PROBES, EARLIER, PRODUCTION, PROBES, VARIANTS, RuleSet, variant

__all__ = ["BEFORE_PROBES", "EARLIER", "PRODUCTION", "PROBES", "VARIANTS", "RuleSet", "variant"]
