from tabulens.plans import frequency, quantiles, storage  # noqa: F401
