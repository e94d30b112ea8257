"""Column functions: rounding, text, arrays, spline basis, exact quantiles."""
