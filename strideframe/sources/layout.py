"""Layouts of the motion corpora and the common window schema."""

# Fixed values of the window schema and of the two corpora's layouts.
CLASSES = ("walk", "upstairs", "downstairs", "sit", "stand", "jog")
CHANNELS = ("acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z")
LINE_LABELS = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
TRIAL_LABELS = {"wlk": 0, "ups": 1, "dws": 2, "sit": 3, "std": 4, "jog": 5}
TRIAL_COLUMNS = ("userAcceleration.x", "userAcceleration.y", "userAcceleration.z", "rotationRate.x", "rotationRate.y", "rotationRate.z")
LINE_SIGNALS = ("body_acc_x", "body_acc_y", "body_acc_z", "body_gyro_x", "body_gyro_y", "body_gyro_z")
LINE_WIN = 128
