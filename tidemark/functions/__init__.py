"""Scalar functions: Columns in, a Column out, all inside code generation unless said otherwise."""
