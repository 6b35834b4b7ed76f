"""Query plans: compositions of the operators over the tables of a scale-factor folder."""
