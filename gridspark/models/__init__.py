"""Models on MLlib. Only fitted parameters and fold-level scalars reach the driver."""
