"""Shared plan shapes: value counts, exact quantiles, running totals, stored intermediates."""
