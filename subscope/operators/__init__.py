from subscope.operators.quantiles import exact_quantiles  # noqa: F401
from subscope.operators.topk import ranked_values  # noqa: F401
from subscope.operators.reshape import unpivot, one_row  # noqa: F401
from subscope.operators.dedup import first_by_key, duplicate_count  # noqa: F401
