"""Operations around queries: transactions, constraints, derivations, rules of three values, types, snapshots, sealed values."""
