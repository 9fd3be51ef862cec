"""Column expressions (JVM side, whole-stage codegen friendly)."""

from cachelens.functions.draws import uniform_draw, md5_order_key
from cachelens.functions.vector import sq_l2, dot, norm_sq, norm, has_nan
from cachelens.functions.text import token_count, is_blank, strip_text, model_family
from cachelens.functions.cost import CostModel

__all__ = [
    "uniform_draw", "md5_order_key", "sq_l2", "dot", "norm_sq", "norm", "has_nan",
    "token_count", "is_blank", "strip_text", "model_family", "CostModel",
]
